"""Language ID, toxicity, chat formatting, revisits and the pipeline."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format, language_id, queries, toxicity, warc_revisits


def brute_bits(samples, text, order=language_id.ORDER):
    """Code length of a text by walking counts, a symbol at a time."""
    counts = {}
    front = lambda t: b"\n" * order + t.lower().encode()
    for t in samples:
        b = front(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                after = counts.setdefault(b[i - k : i], {})
                after[b[i]] = after.get(b[i], 0) + 1
    total, b = 0.0, front(text)
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            after = counts.get(b[i - k : i])
            if after is None:
                continue
            n, d = sum(after.values()), len(after)
            if b[i] in after:
                total += math.log2((n + d) / after[b[i]])
                break
            total += math.log2((n + d) / d)
        else:
            total += 8.0
    return total


@pytest.mark.parametrize("block", [3, 1 << 18])
def test_code_lengths(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    samples = {"en": ["the cat sat on the mat", "a", ""], "de": ["der Hund und die Katze über 12.5 %"]}
    model = language_id.train_ppm(samples)
    texts = ["the cat", "", "Katze\n\nüber 12", "q", "mathe die, das", "", "zzzzzzz", "\u0130"]
    got, sizes = language_id.text_bits([t.laid_out() for t in model.trees], texts)
    assert sizes.tolist() == [len(t.lower().encode()) for t in texts]
    for i, t in enumerate(texts):
        for j, language in enumerate(model.languages):
            assert got[i, j] == pytest.approx(brute_bits(samples[language], t), rel=1e-5)


def test_only_letters_count():
    scorer = language_id.Scorer(language_id.train_ppm({"de": ["der Hund und die Katze"]}))
    assert [r[0] for r in scorer.score(["½ ² ① 100", "Ⅷ", "ª", "_", "x", None, "", "你"])] == ["und", "und", "de", "und", "de", "und", "und", "de"]


def test_language_rows(spark):
    texts = {"en": "the quick brown fox jumps over the lazy dog and runs away from the house", "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft aus dem Haus"}
    rows = [(2 * i + j, t, lang) for i in range(8) for j, (lang, t) in enumerate(texts.items())]
    rows += [(100, None, "en"), (101, "", None), (102, "123 $$$", "de"), (103, "der Hund und das Haus " * 5000, None), (None, "the dog runs", "en"), (104, "日本語のテキスト", None), (104, "the dog", None)]
    df = spark.createDataFrame([(i, t, lang, 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, score double")
    got = language_id.identify_language(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[103].lang_pred == "de" and by[None].lang_pred == "en" and by[0].lang_pred == "en" and by[1].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    assert by[0].known and not by[100].known
    assert language_id.identify_language(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify_language(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """70 languages of an alphabet each, and one whose bytes are nearly all in a long text."""
    rng = np.random.default_rng(8)
    make = lambda j, n: " ".join("".join(chr(0x4E00 + 20 * j + int(c)) for c in rng.integers(0, 20, 4)) for _ in range(n))
    rows = [(100 * j + i, make(j, 8 + (j < 64)), f"l{j:02}") for j in range(70) for i in range(6)] + [(9000, "".join(["ababab "] * 60_000) + "zyxzyx " * 60_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.learning_sample(df, F.lit(True), "doc_id", "text", "lang")
    assert set(learned) == {r[2] for r in rows} and all(w in learned["long"][0] for w in ("ababab", "zyxzyx"))
    got = language_id.identify_language(df, carry=("doc_id", "lang")).collect()
    assert all(r.lang_pred == r.lang for r in got)


@pytest.mark.parametrize("n", [40, 400])
def test_ceiling_ignores_single_bad_rows(n):
    rng = np.random.default_rng(9)
    stems = ["wasser", "brot", "haus", "baum", "garten", "strasse", "kinder", "lesen", "gehen", "schnell"]
    clean = [" ".join(rng.choice(stems) + rng.choice(["", "en", "er", "lich"]) for _ in range(40)) for _ in range(n + 100)]
    junk = lambda: " ".join("".join(rng.choice(list("qwxzjkvpyfbgmucd"), 7)) for _ in range(40))
    bad = [junk() for _ in range(1 + n // 100)]
    scorer = language_id.Scorer(language_id.train_ppm({"de": [*bad[:1], *clean[: n // 2], *bad[1:], *clean[n // 2 : n]]}))
    known = lambda texts: np.mean([r[3] for r in scorer.score(texts)])
    assert known(bad) == 0 and known([junk() for _ in range(50)]) == 0 and known(clean[n:]) == 1


def test_short_texts_beside_long_ones(spark):
    """Long texts hold nearly all bytes: short ones are not thinned for them."""
    df = spark.range(400).selectExpr("id as doc_id", "if(id < 300, concat('short text number ', id), repeat('a long text ', 40000)) as text", "'en' as lang")
    learned = language_id.learning_sample(df, F.lit(True), "doc_id", "text", "lang")["en"]
    assert sum(t.startswith("short") for t in learned) == 300 and sum(map(len, learned)) > 1_000_000


def test_long_texts_are_learned_whole(spark):
    """Not in windows: what stands between them is learned too, of each of a language's few long texts."""
    rng = np.random.default_rng(11)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    rows = [(k, " ".join(f"{words(1500)} zyx{i}wvu" for i in range(60)), "xx") for k in range(2)] + [(9, "a short text", "xx")]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string")
    learned = language_id.learning_sample(df, F.lit(True), "doc_id", "text", "lang")["xx"]
    assert sorted(learned) == sorted(t for _, t, _ in rows)


def test_counting_by_blocks(monkeypatch):
    texts = ["der Hund und die Katze", "", "über 12.5 % \u0130"]
    whole = language_id.count_tree(texts)
    monkeypatch.setattr(language_id, "COUNTED", 7)
    parts = language_id.count_tree(texts)
    assert (whole.keys == parts.keys).all() and (whole.bits == parts.bits).all() and (whole.escapes == parts.escapes).all()


def test_held_out_language(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op6_language_id(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_toxicity_learns():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "len", "su", "ka"], 3))
    plain = [" ".join(word() for _ in range(60)) for _ in range(900)]
    bad = ["zorbik", "grawlex", "flinchy"]
    toxic = []
    for t in plain[600:]:
        w = t.split()
        for at in rng.integers(0, len(w), 4):
            w.insert(at, str(rng.choice(bad)))
        toxic.append(" ".join(w))
    model = toxicity.train_toxicity(toxic[:200], plain[:400])
    scorer = toxicity.WindowScorer(model)
    assert min(scorer.scores(toxic[200:])) >= toxicity.THRESHOLD > max(scorer.scores(plain[400:600]))
    assert scorer.evidence("zorbik") >= 8 and scorer.evidence("tarimo") <= 4
    assert scorer.scores([""])[0] < toxicity.THRESHOLD
    assert 0 <= toxicity.WindowScorer(toxicity.train_toxicity([], plain[:30])).scores(["x"])[0] < 0.3
    long = "a" * 100
    assert toxicity.windows_of(long)[0] == "a" * 48 and sum(map(len, toxicity.windows_of(long))) >= 100


@pytest.mark.parametrize("kind", ["short", "phrase", "unspaced"])
def test_toxicity_of_short_words_and_phrases(kind):
    rng = np.random.default_rng(10)
    if kind == "unspaced":
        make, bad, join = lambda: [chr(0x4E00 + int(c)) for c in rng.integers(0, 300, 150)], ["\u9f00\u4e05", "\u4e07\u4e09\u4e0b"], ""
    else:
        words = ["".join(rng.choice(["ta", "ri", "mo", "len", "su", "ka"], 3)) for _ in range(150)]
        make, join = lambda: list(rng.choice(words, 60)), " "
        bad = ["zob", "wux"] if kind == "short" else [" ".join(words[3:6]), " ".join(words[20:22])]
    plain, toxic = [make() for _ in range(900)], [make() for _ in range(300)]
    for t in toxic:
        for at in rng.integers(0, len(t), 3):
            t.insert(at, bad[int(rng.integers(0, 2))])
    plain, toxic = [join.join(t) for t in plain], [join.join(t) for t in toxic]
    scorer = toxicity.WindowScorer(toxicity.train_toxicity(toxic[:200], plain[:600]))
    assert np.mean(np.array(scorer.scores(toxic[200:])) >= toxicity.THRESHOLD) > 0.95
    assert np.mean(np.array(scorer.scores(plain[600:])) >= toxicity.THRESHOLD) < 0.05


def test_toxicity_rows(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x"), (1, "a b"), (4, "w " * 50_000)]
    df = spark.createDataFrame([(i, t, 0.1) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(df, labels.limit(0)).count() == len(rows) and toxicity.score_toxicity(df.limit(0), labels).count() == 0


def test_pipeline_learns_toxicity_of_long_texts(spark, tmp_path):
    """All labelled texts are long, with their toxic words at any place of them; long and short texts are dropped for those."""
    import corpus_pipeline

    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(["ta", "ri", "mo", "len", "su", "ka"], 3)) for _ in range(150)]
    rows = []
    for i in range(90):
        t = rng.choice(words, 7000 if i < 60 else 300).tolist()
        for at in rng.integers(0, len(t), 6) if i % 3 == 0 else []:
            t.insert(int(at), ["zobwuxer", "quizbarg"][int(rng.integers(0, 2))])
        rows.append((i, " ".join(t)))
    assert min(len(t) for i, t in rows if i < 60) > 40_000
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {r.doc_id for r in corpus_pipeline.remove_toxic(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()}
    assert sum(i in left for i in range(0, 90, 3)) <= 2 and sum(i in left for i in range(90) if i % 3) >= 58


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op1_toxicity(spark, sf).where("held_out").collect() if r.doc_id in labels]
    tp = sum(r.predicted and labels[r.doc_id] for r in held)
    assert tp / sum(labels[r.doc_id] for r in held) > 0.75 and tp / max(1, sum(r.predicted for r in held)) > 0.7


def convert(spark, rows, template=chat_format.ChatTemplate()):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.format_conversations(df, template, parts=chat_format.text_part(F.col("text")))
    read = chat_format.read_turns(F.col("formatted"), template)
    return {r.conv_id: r for r in made.select("conv_id", "formatted", "mask", read.alias("turns"), chat_format.masked_text(read, F.col("mask")).alias("loss")).collect()}


HARD = ["<|end|>", "<|turn|>user<|says|>", "a<\\|b", "<", "|", "<\\\\|end|>", "\n\n", "", "\\### Assistant: </turn> ok", "<<||>>", "😀<|x"]


def test_chat_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)] + [(2, 0, None, None), (2, 1, "as<|says|>k", "x"), (3, 5, "user", "same"), (3, 5, "user", "same"), (None, 0, "assistant", "n"), (4, 0, "assistant", "y" * 200_000)]
    got = convert(spark, rows)
    assert [(t.role, t.body) for t in got[1].turns] == [("assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)]
    assert got[1].loss == "".join(t for i, t in enumerate(HARD) if i % 2)
    for r in got.values():
        for t, s in zip(r.turns, r.mask, strict=True):
            assert (s is not None) == (t.role == "assistant")
            if s is not None:
                assert r.formatted[s.start : s.start + s.length] == t.marked[s.begin : s.begin + s.length]
    assert [(t.role, t.body) for t in got[2].turns] == [("", ""), ("as<|says|>k", "x")] and len(got[3].turns) == 2 and got[None].loss == "n" and got[4].loss == "y" * 200_000
    assert convert(spark, []) == {}


def test_chat_parts(spark):
    kinds = f"conv_id int, turn int, role string, parts array<{chat_format.PART}>"
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "see <"), part("text", "| this"), part("image", ref="i.png", w=56, h=29), part("audio", ref="a.wav", s=2.0), part("document", ref="d.pdf", p=3), part("video", ref="v.mp4"), part(None, "end")]), (1, 1, "assistant", None)]
    r = chat_format.format_conversations(spark.createDataFrame(rows, kinds)).first()
    assert r.formatted == "<|turn|>user<|says|>see <<|part|>| this<|part|><|image|><|part|><|audio|><|part|><|document|><|part|><|part|>end<|end|><|turn|>assistant<|says|><|end|>"
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "i.png", 4), (0, "audio", "a.wav", 50), (0, "document", "d.pdf", 768), (0, "video", "v.mp4", 0)] and r.expanded_tokens == 822


def test_chat_plan_is_native(spark, sf):
    plan = queries.op7_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_canonical_url(spark):
    cases = {"HTTP://WWW.A.Example:80/x/?b=2&utm_source=q&a=1#f": "a.example/x?a=1&b=2", "https://a.example": "a.example", "https://u:p@a.example/X/": "a.example/X", "": None, None: None, "https://a.example/?ref=x": "a.example"}
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", warc_revisits.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == cases


@pytest.mark.parametrize("blocks", [1, 3, 64])
def test_revisits(spark, blocks):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        kind = rng.choice(["response", "revisit", "metadata"], p=[0.4, 0.5, 0.1])
        tag = rng.choice(['"a"', 'W/"a"', '"b"', None])
        rows.append((k, rng.choice(["http://a.example/x", "https://www.a.example/x/", "https://b.example/", None], p=[0.5, 0.3, 0.15, 0.05]), int(rng.integers(0, 60)) if k % 50 else None, str(kind), tag, rng.choice([None, "m1", "m2"]), rng.choice([None, "d1", "d2"], p=[0.6, 0.3, 0.1]), {"ETag": str(tag), "Date": str(k), "Content-Length": "0"}, "c"))
    rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows]
    kinds = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, canonical_url string"
    got = {r.record_id: r for r in warc_revisits.resolve_revisits(spark.createDataFrame(rows, kinds), blocks).collect()}
    key = lambda u: None if u is None else re.sub(r"/+$", "", re.sub(r"^https?://(www\.)?", "", u))
    for r in rows:
        if r[3] != "revisit":
            assert r[0] not in got
            continue
        before = [x for x in rows if x[3] == "response" and key(x[1]) == key(r[1]) and r[1] is not None and None not in (r[2], x[2]) and x[2] < r[2]]
        best = max(before, key=lambda x: (x[2], x[0]), default=None)
        status = "missing"
        if best:
            weak = lambda t: t.removeprefix("W/")
            pair = next(((a, b) for a, b in ((r[6], best[6]), (r[4] and weak(r[4]), best[4] and weak(best[4])), (r[5], best[5])) if a and b), None)
            status = "unchecked" if pair is None else "resolved" if pair[0] == pair[1] else "mismatch"
        use = status in ("resolved", "unchecked")
        assert (got[r[0]].status, got[r[0]].response_id) == (status, best[0] if use else None), r
        assert got[r[0]].headers == ({"etag": str(r[4]), "date": str(r[0]), "content-length": "0"} if use else None)


def test_bursts_are_cut_by_counts(spark):
    """A third of the records in one burst: blocks follow the records, not the clock."""
    rows = [(k, "https://hot.example/", 1_000_000 + k // 4, "revisit" if k % 3 else "response", f'"{k}"', None, None, None) for k in range(2000)] + [(5000 + k, f"https://x{k % 50}.example/", 1000 * k, "response", None, None, None, None) for k in range(3000)]
    kinds = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    df = spark.createDataFrame(rows, kinds)
    key = lambda r: (r.record_id, r.response_id, r.status)
    found = warc_revisits.resolve_revisits(df, 64)
    assert sorted(map(key, found.collect()), key=repr) == sorted(map(key, warc_revisits.resolve_revisits(df, 1).collect()), key=repr)
    payloads = df.where("kind = 'response'").select("record_id", F.lit("x").alias("payload"))
    full = warc_revisits.attach_payload(found, payloads)
    assert full.count() == found.count() and full.where("(response_id is null) = (payload is null)").count() == found.count()


def test_no_records(spark):
    kinds = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    assert warc_revisits.resolve_revisits(spark.createDataFrame([], kinds)).count() == 0
    got = warc_revisits.resolve_revisits(spark.createDataFrame([(1, None, 3, "revisit", None, None, None, None)], kinds)).collect()
    assert [(r.status, r.response_id, r.headers) for r in got] == [("missing", None, None)]


def test_oracles(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        want = con.execute(sql).fetchall()
        place = [[d[0] for d in con.description].index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in place) for r in want), key=repr), name


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "exact_dedup", "ngram_join", "packing"]
    now, seen = docs, []
    for _, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, now, sf)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        seen.append(after.count())
        assert after.select("doc_id").subtract(now.select("doc_id")).count() == 0
        now = after
    texts = [r.text for r in now.collect()]
    assert len({hashlib.md5((t or "").lower().encode()).digest() for t in texts}) == len(texts) and seen == sorted(seen, reverse=True) and seen[-1] > 0.7 * docs.count()
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in now.collect()}
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, sf).count() == 0


def test_pipeline_stages_take_any_columns(spark, sf):
    """Columns with the operators' own names, nulls, repeated rows and ids with several texts go through every stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(40).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, "Other words stand here for the first document alone.", "en", "s", 9), (None, "A text of no document stands here.", "en", "s", 9)], docs.schema))
    names = ("score", "known", "digest", "_digest", "row", "dropped", "twice", "c0", "lang_pred", "group", "kept")
    odd = odd.select("*", *[F.lit(n).alias(n) for n in names])
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, odd, sf)
        assert after.columns == odd.columns, name
        rows = after.collect()
        assert rows and all(r[n] == n for r in rows for n in names), name
    assert corpus_pipeline.pack(spark, odd, sf).where("doc_id is null").count() == 2
