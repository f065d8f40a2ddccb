"""HTML and URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import clean_text, matched, matches

#: Named entities in the order in which they are replaced. Fixed values.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def decode_entities(text: Column) -> Column:
    """Six named entities, then decimal and hexadecimal ones."""
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))

    def numeric(t: Column, pattern: str, base: int) -> Column:
        # pieces before, and each entity: even places are text, odd places a number
        marked = F.regexp_replace(t, pattern, "\u0001$1\u0002")
        parts = F.split(marked, "\u0001")

        def piece(x: Column, i: Column) -> Column:
            code = F.conv(F.substring_index(x, "\u0002", 1), base, 10).cast("int")
            return F.when((i == 0) | (F.instr(x, "\u0002") == 0), x).otherwise(F.concat(F.chr(code) if base == 0 else _char(code), F.substr(x, F.instr(x, "\u0002") + 1)))

        return F.when(t.rlike(pattern), F.array_join(F.transform(parts, piece), "")).otherwise(t)

    return numeric(numeric(text, r"&#(\d{1,6});", 10), r"(?i)&#x([0-9a-f]{1,5});", 16)


def _char(code: Column) -> Column:
    """The character of a code point, through its UTF-16 form."""
    unit = lambda x: F.lpad(F.hex(x), 4, "0")
    above = code - 0x10000
    pair = F.concat(unit(F.lit(0xD800) + F.floor(above / 1024)), unit(F.lit(0xDC00) + above % 1024))
    bad = code.between(0xD800, 0xDFFF) | (code > 0x10FFFF) | (code == 0)
    return F.when(bad, F.lit("�")).otherwise(F.decode(F.unhex(F.when(code > 0xFFFF, pair).otherwise(unit(code))), "UTF-16BE"))


def html_title(html: Column) -> Column:
    return decode_entities(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")))


def primary_html(html: Column) -> Column:
    """The longest body of main, article or a content-like div; the whole page where there is none."""
    bodies = F.concat(
        F.regexp_extract_all(html, F.lit(r"(?is)<main(?![A-Za-z0-9_])[^>]*>(.*?)</main>"), F.lit(1)),
        F.regexp_extract_all(html, F.lit(r"(?is)<article(?![A-Za-z0-9_])[^>]*>(.*?)</article>"), F.lit(1)),
        F.regexp_extract_all(html, F.lit(r"""(?is)<div(?![A-Za-z0-9_])[^>]*(?:class|id)=["'][^"']*(?:content|docs|article|markdown|main)[^"']*["'][^>]*>(.*?)</div>"""), F.lit(1)),
    )
    bodies = F.filter(F.transform(bodies, lambda x: F.trim(x)), lambda x: x != "")
    longest = F.array_max(F.transform(bodies, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return F.coalesce(longest["x"], html)


def readable_text(html: Column) -> Column:
    """The primary body's text, a line for each block."""
    t = primary_html(html)
    for pattern, value in (
        (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?is)<noscript.*?</noscript>", " "),
        (r"(?i)</(p|div|section|article|li|h[1-6]|tr)>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
    ):
        t = F.regexp_replace(t, pattern, value)
    return decode_entities(F.regexp_replace(t, r"^\s+|\s+$", ""))


def html_to_text(html: Column) -> Column:
    """A fragment's text in one line; null if there is none."""
    t = F.regexp_replace(html, r"(?i)<br\s*/?>|</?(?:p|div|li|tr|td|th|h[1-6])(?:\s[^>]*)?>", "\n")
    t = clean_text(decode_entities(F.regexp_replace(F.regexp_replace(t, r"(?is)<!--.*?-->", ""), r"<[^>]+>", "")))
    return F.when(t != "", t)


def sanitize_accordion(html: Column) -> Column:
    """Scripts, styles, handlers and tags that are not allowed dropped."""
    t = html
    for pattern in (r"(?is)<(script|style|iframe|object|embed)\b.*?</\1>", r"""(?i)\son[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", r"""(?i)\sstyle\s*=\s*("[^"]*"|'[^']*')""", r"""(?i)\s(href|src)\s*=\s*("javascript:[^"]*"|'javascript:[^']*')""", r"(?i)</?(?!(?:details|summary|section|div|h[1-6]|p|ul|ol|li|strong|em|br|dl|dt|dd|span)\b)[a-z][^>]*>"):
        t = F.regexp_replace(t, pattern, "")
    return F.trim(t)


def strip_fenced_code(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)```.*?```", " ")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def is_blocked_host(host: Column) -> Column:
    """Local names, loopback, private and link-local addresses, malformed octets."""
    octets = F.split(host, r"\.")
    ip = host.rlike(r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$")
    part = lambda i: F.when(ip, octets[i]).cast("int")
    first, second = part(0), part(1)
    private = (first.isin(10, 127)) | ((first == 169) & (second == 254)) | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168))
    beyond = (F.greatest(*[part(i) for i in range(4)])) > 255
    return host.isin("localhost", "0.0.0.0", "::1", "[::1]") | host.endswith(".localhost") | F.coalesce(ip & (private | beyond), F.lit(False))


def is_public_url(url: Column, domains: tuple[str, ...] = ()) -> Column:
    """An http(s) address of a public host, of one of the domains if there are any."""
    host = host_of(url)
    ok = matches(url, "^https?://") & (host != "") & ~is_blocked_host(host)
    if domains:
        inside = F.lit(False)
        for d in domains:
            inside = inside | (host == d.lower()) | host.endswith("." + d.lower())
        ok = ok & inside
    return ok


def extract_urls(text: Column) -> Column:
    """Public addresses in a text outside code fences, closing punctuation trimmed."""
    found = matched(strip_fenced_code(text), r"""https?://[^\s<>"')\]]+""")
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")), lambda u: is_public_url(u))


def is_supported_content_type(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return (k == "") | k.rlike("text/html|text/plain|text/markdown|application/json|application/xhtml\\+xml")


_SIZE = r"(?i)_(?:\d+x\d*|x\d+)(?=\.[a-z]{3,5}$)"


def image_key(url: Column) -> Column:
    """Origin and path of an image in lower case, without its size suffix."""
    bare = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    return F.lower(F.regexp_replace(bare, _SIZE, ""))


def image_dedupe_key(url: Column) -> Column:
    """Host and path in lower case, without the size suffix."""
    return F.regexp_replace(image_key(url), r"^[a-z][a-z0-9+.-]*://", "")


def image_width(url: Column) -> Column:
    """The width that a query parameter or a suffix names, else 0."""
    query = F.regexp_extract(url, r"[?&](?:width|w)=(\d+)", 1)
    path = F.regexp_extract(url, r"(?i)_(\d+)x(?:\d+)?(?=\.)", 1)
    number = lambda x: F.nullif(x, F.lit("")).cast("long")
    return F.coalesce(F.nullif(number(query), F.lit(0).cast("long")), number(path), F.lit(0).cast("long"))


def canonical_image(url: Column) -> Column:
    """An https address without size and format parameters or fragment; null for data: addresses and vector images."""
    bare = F.substring_index(F.trim(url), "#", 1)
    path, query = F.substring_index(bare, "?", 1), F.when(F.instr(bare, "?") > 0, F.substr(bare, F.instr(bare, "?") + 1)).otherwise("")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~matches(p, "^(width|height|w|h|size|quality|q|format|fm|auto|fit|crop|dpr|v)="))
    full = F.concat(F.regexp_replace(F.regexp_replace(path, "^//", "https://"), "(?i)^http://", "https://"), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(matches(full, "^https://") & ~matches(path, r"\.svg$"), full)


def is_low_quality_image(url: Column) -> Column:
    """A named size of 96 or less, or the words of icons and spinners."""
    sizes = F.transform(F.regexp_extract_all(url, F.lit(r"(?i)(?:[_?&=-]|w=|width=|h=|height=)(\d{1,4})(?:x\d*|(?=[._&]|$))"), F.lit(1)), lambda x: x.cast("int"))
    return F.exists(sizes, lambda n: (n > 0) & (n <= 96)) | matches(url, r"(icon|logo|sprite|badge|placeholder|blank|spacer|loading|favicon|thumb)")


def product_handle(url: Column) -> Column:
    """The path segment after ``products``; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"(?i)/products/([^/?#]+)", 1), F.lit(""))
