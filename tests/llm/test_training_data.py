"""The queries against brute-force versions over all rows of a small input with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
ODD = [
    (10_001, None, "en", "src1"), (10_002, "", None, None), (None, "no id here at all, with ten words or so in it", "en", "src0"),
    (10_003, "one two", "en", "src1"), (10_003, "one two", "en", "src1"), (10_004, " \n\t \n", "fr", "src2"),
    (10_005, "mail a@b.c_d@e.f and x@y, 1.2.3.4.5 256.1.1.1 4111 1111 1111 1111 +1 (800) 555-0100 " + "9" * 5000, "en", "src1"),
    (10_006, "word " * 30_000, "en", "src9"), (10_007, "a\nb\nc\na\nb\nc\na\nb\nc", "de", "src1"), (10_008, "tab\there  double  spaces \n\n end ", "en", None),
    (10_009, "x" * 50_000 + " É " + "😀 emoji 😀@x.y.z", "es", "src3"),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A copy of the smallest tables with odd rows and a column of a clashing name."""
    from pyspark.sql import functions as F

    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.unionByName(odd).withColumn("node", F.lit("clash")).write.parquet(f"{at}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.unionByName(spark.createDataFrame([(None, "null id item"), (900, None), (901, ""), (902, "one two"), (903, "Word word WORD")], "item_id long, text string")).write.parquet(f"{at}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(10_001, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")).write.parquet(f"{at}/labels.parquet")
    big = "<p>" + "same " * 300 + "</p>"
    spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame([(9001, None, None), (9002, "u\n", ""), (9003, "u", big), (9004, "u", big), (9004, "u", big), (None, "u", big), (9005, "u", "short"), (9006, "u", "short")], "page_id long, url string, html string")).write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return s.encode().lower().decode()


def test_decontaminate(spark, sf, docs):
    from kinlink.llm import decontaminate
    from kinlink.llm.queries import op2_decontaminate

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    items = [(str(r.item_id), find(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.item_id is not None]
    want = Counter()
    for d, t, _ in docs:
        w, hit, got = find(t), set(), set()
        at = defaultdict(list)
        for i, x in enumerate(w):
            at[x].append(i)
        for item, ws in items:
            k = min(10, len(ws))
            for a in range(len(ws) - k + 1) if ws else ():
                for i in at[ws[a]]:
                    if w[i : i + k] == ws[a : a + k]:
                        hit |= set(range(i, i + k))
                        got.add(item)
        want[d, len(w), len(hit), len(got), sha(",".join(sorted(got))), bool(hit)] += 1
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(op2_decontaminate(spark, sf), *cols) == want
    assert any(k[2] for k in want)
    old, decontaminate.PART_BYTES = decontaminate.PART_BYTES, 2_000
    try:
        assert rows(op2_decontaminate(spark, sf), *cols) == want
        # Texts of one id, or none, and of as many words stay apart in all parts.
        items = [(int(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.item_id is not None and r.text]
        texts = [(None, items[0][1]), (None, items[-6][1]), (7, "plain " * 12), (7, items[3][1])]
        d = decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet"), ["doc_id", "text"])
        got = {r.text: set(r["items"]) for r in d.select("row.*", "items").collect()}
        assert [str(i) in got[t] for t, i in ((items[0][1], items[0][0]), (items[-6][1], items[-6][0]), (items[3][1], items[3][0]))] == [True] * 3 and got["plain " * 12] == set()
    finally:
        decontaminate.PART_BYTES = old


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def base(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) if k != "email" or "@" in t for m in re.finditer(p, t) if ok(m[0]))


def test_pii(spark, sf, docs):
    from kinlink.llm.queries import op3_pii

    want = Counter()
    for d, t, _ in docs:
        s = base(t if t and len(t) < 40_000 else (t or "")[-60:].rjust(len(t or ""), "\n"))
        n = Counter(k for *_, k in s)
        want[d, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{z}" for a, _, z, k in s))] += 1
    got = op3_pii(spark, sf).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) for r in got) == want


def test_pii_bootstrap(spark):
    from kinlink.llm.pii import digest, personal_data

    texts = [f"word{'' if i % 2 else 's'} goes mail address: user{i}@host.com then on" for i in range(9)] + ["we use mail address: user7731.host now", "plain 12345 text only"]
    got = {r.doc_id: r for r in digest(personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert got[9].spans == "email:21:34" and got[9].n_email == 0
    assert got[10].spans == "" and got[0].spans == "email:25:39"


def test_pii_counts_patterns_in_all_documents(spark):
    from kinlink.llm.pii import digest, personal_data

    seeds = [(i, f"please use mail address: user{i}@host.com then on") for i in range(9)]
    other = [(50, "we use mail address: user7731.host now")]
    plain = [(100 + i, "no mail address: given here at all") for i in range(90)]
    spans = lambda rows: {r.doc_id: r.spans for r in digest(personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}[50]
    assert spans(seeds + other + plain) == ""
    # One text of one id, repeated, counts once.
    assert spans(seeds + other + [plain[0]] * 90) == "email:21:34"


def test_pii_reads_long_contexts_and_learns_from_what_it_found(spark):
    from kinlink.llm.pii import digest, personal_data

    far = "https://x.example/" + "y" * 300
    texts = [f"please {far} address: user{i}@host.com then on" for i in range(9)] + [f"{far} address: user7731.host now"]
    # What the first pattern discovers induces a second, which discovers more; none of these is of a fixed shape.
    texts += [f"ask for pass code: badge{i}.x end" for i in range(9)] + [f"word mail address: badge{i}.x end" for i in range(9)] + [f"we mail address: n{i}@host.com end" for i in range(60)]
    texts += ["ask for pass code: gate9.y end"]
    got = {r.doc_id: r.spans for r in digest(personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    at = len(far) + 10
    assert got[9] == f"email:{at}:{at + 13}"
    assert got[len(texts) - 1] == "email:19:26"


def test_pii_places_of_very_many_matches(spark):
    from kinlink.llm.pii import digest, personal_data

    text = "é " + " ".join(f"a{i}@b.c" for i in range(3000))
    (r,) = digest(personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert r.n_email == 3000 and r.base_sha256 == sha(",".join(f"{k}:{a}:{z}" for a, _, z, k in base(text)))


def test_tokens(spark, sf, docs):
    from tokenizers import Tokenizer

    from kinlink.llm.queries import op5_tokens, tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    start, by = 0, defaultdict(list)
    got = op5_tokens(spark, sf).collect()
    for d, text, _ in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        by[d].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, *x) for d, xs in by.items() for x in xs)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in got), key=lambda d: -1 if d is None else d)
    for r in ordered:
        assert r.start == start
        start += r.n_tokens


def test_tokens_of_odd_texts_are_the_librarys():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from kinlink.llm.queries import tokenizer_path
    from kinlink.llm.tokens import _Pieces, encode_texts, encoder

    t, rng = Tokenizer.from_file(tokenizer_path()), np.random.default_rng(8)
    bits = [" ", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\r\n", " \n", "\n ", "a", "b", "don't", "'s", "'ll", "É", "ß", "日本", "😀", "1", "23", "٣", "²", "-", "...", "—", "\xa0", "\u3000", "\x85", "\x1c", "\x00", "\x01", "<|endoftext|>", "word", "the", "\u0301", "ɐ", "×", "ÿ", "_", '"']
    texts = ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(5000)] + ["word " * 40_000, "x" * 100_000, "x<|endoftext|>y", "\x01"]
    got = list(encode_texts(_Pieces(encoder(tokenizer_path())), pa.array(texts, pa.string())))
    assert [g.tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert 50256 in got[-2].tolist()


_TASKS = """
import re
import numpy as np, pyarrow as pa
from kinlink.llm.queries import tokenizer_path
from kinlink.llm.tokens import _write, encoder

def used():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10

def batches(seed, n):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        texts = [" ".join(map(str, rng.integers(0, 200_000, 400))) for _ in range(4_000)]
        yield pa.RecordBatch.from_arrays([pa.array([0] * 4_000, pa.int32()), pa.array(range(4_000)), pa.array(texts)], ["part", "doc_id", "text"])

encoder(tokenizer_path())
list(map(len, _write(tokenizer_path())(batches(0, 0))))
before = used()
for seed in range(2):
    assert sum(b.num_rows for b in _write(tokenizer_path())(batches(seed, 2))) > 1
print(used() - before)
"""


def test_token_workers_give_memory_back():
    import subprocess
    import sys
    from pathlib import Path

    if not sys.platform.startswith("linux"):
        pytest.skip("reads /proc")
    # A process of its own, as a worker that Spark keeps beside the executor between tasks.
    ran = subprocess.run([sys.executable, "-c", _TASKS], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert int(ran.stdout) < 60


def test_warc(spark, sf):
    from kinlink.llm.queries import op7_warc

    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    top = defaultdict(list)
    for p, h in pages:
        if len(h) >= 1000:
            top[h].append(-1 if p is None else p)
    want = Counter()
    for p, h in pages:
        best = max(top[h]) if h in top else None
        same = best is None or best == p or len(top[h]) == 1
        want[p, len(h), hashlib.sha1(h).hexdigest(), "response" if same else "revisit", None if same else best] += 1
    assert rows(op7_warc(spark, sf), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want


def test_warc_streams_of_all_kinds():
    import zlib as z

    from kinlink.llm.warc import deflate, normalise_archive, record, split_stream

    records = [record(i, f"u{i}", b"x" * n, "0" * 40, None) for i, n in enumerate((0, 5, 3000, 70_000))]
    for piece in (7, 1 << 20):
        assert list(split_stream(deflate(b"".join(records)), piece)) == records
        assert list(split_stream(b"".join(map(deflate, records)), piece)) == records
        assert list(split_stream(deflate(records[0]) + deflate(b"".join(records[1:])), piece)) == records
    data, index = normalise_archive(deflate(b"".join(records)))
    assert [z.decompress(data[o : o + n], 31) for o, n in index] == records and list(split_stream(b"")) == []
    for bad in (deflate(b"".join(records))[:-20], deflate(b"".join(records)[:-9]), deflate(records[0])[:-4], deflate(b"no record\r\n\r\n")):
        with pytest.raises(ValueError):
            list(split_stream(bad))
    with pytest.raises(z.error):
        list(split_stream(b"junk" * 50))


def measures(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    rep = {i + j for i in range(len(ws) - 4) if win[tuple(ws[i : i + 5])] > 1 for j in range(5)}
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), n < 10 or 100 * len(rep) > 20 * n


def test_quality(spark, sf, docs):
    from kinlink.llm.queries import op8_quality

    got = op8_quality(spark, sf).collect()
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in cols) for r in got) == Counter((d, *measures(t)) for d, t, _ in docs)
    assert all(not (r.base_failed and r.kept) for r in got)
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    assert sum(r.kept for r in got if r.doc_id in good and not r.base_failed) >= 0.99 * sum(1 for r in got if r.doc_id in good and not r.base_failed)
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").collect()}
    assert sum(r.kept for r in got if r.doc_id in bad) <= 0.3 * len(bad)


def brute_verdicts(rows):
    """kept of (lang, source, text) rows, from quantiles of binned values."""
    def line_counts(t):
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(lines)

    feats = []
    for lang, source, t in rows:
        n, chars, symbols, dups, _, failed = measures(t)
        feats.append((lang, source, failed, symbols / max(chars, 1), dups / max(line_counts(t), 1), chars / max(n, 1)))

    def quantiles(values):
        bins = sorted(math.ceil(math.log(v) / math.log(1.02)) if v > 1e-9 else -(1 << 20) for v in values)
        pick = lambda q: bins[max(0, math.ceil(q * len(bins) - 1e-12) - 1)]
        return [0.0 if (b := pick(q)) == -(1 << 20) else 2 / 2.02 * 1.02**b for q in (0.25, 0.5)]

    groups = defaultdict(list)
    for f in feats:
        if not f[2]:
            for key in ((f[0], f[1]), (f[0], "any"), ("any", "any")):
                groups[(*key, len(key[1] or "") >= 0)].append(f[3:])
    limits = ((0.0075, 0.20), (0.04, 0.60), (0.2, 20.0))
    drawn = lambda q, n, wider: (q * n + wider * 20) / (n + 20)
    out = []
    for lang, source, failed, *xs in feats:
        ok = not failed
        for i, (spread, highest) in enumerate(limits):
            if failed:
                break
            sets = [groups[k][:] for k in ((lang, source, True), (lang, "any", True), ("any", "any", True))]
            own, wide, pool = (quantiles([v[i] for v in x]) for x in sets)
            low, mid = (drawn(own[j], len(sets[0]), drawn(wide[j], len(sets[1]), pool[j])) for j in (0, 1))
            ok = ok and xs[i] <= min(mid + 8 * max(mid - low, spread), highest)
        out.append(ok)
    return out


def test_quality_verdicts_by_brute_force(spark, sf):
    from kinlink.llm.queries import op8_quality
    from kinlink.llm.quality import judge

    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows_ = [(r.doc_id, r.lang, r.source, r.text) for r in d.collect()]
    want = Counter((i, k) for (i, *_), k in zip(rows_, brute_verdicts([r[1:] for r in rows_]), strict=True))
    assert rows(op8_quality(spark, sf), "doc_id", "kept") == want
    # Sketches merge to the same verdicts however rows are dealt.
    assert rows(judge(d.repartition(13), ["doc_id"]).select("row.doc_id", "kept"), "doc_id", "kept") == want


CLASH = ["row", "n_words", "kept", "m", "lines", "size", "src", "h", "shards", "shard", "target", "source_size", "gone", "key", "n_lines", "n_removed", "spans", "items", "part", "block", "node", "class_id", "bands", "of", "found", "base", "_text", "_m", "_size"]


@pytest.mark.parametrize("stage", ["quality", "near", "clean", "mix", "lines"])
def test_clashing_columns_come_through(spark, sf, stage):
    from pyspark.sql import functions as F

    from kinlink.llm import decontaminate, linededup, mixing, neardup, quality

    d = spark.read.parquet(f"{sf}/documents.parquet").drop("node")
    d = d.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASH])
    f = {"quality": quality.filter_documents, "near": neardup.one_of_each, "clean": lambda x: decontaminate.clean_documents(x, spark.read.parquet(f"{sf}/benchmark.parquet")), "mix": mixing.mixed_documents, "lines": linededup.dedup_lines}[stage]
    out = f(d)
    assert out.columns[: len(d.columns)] == d.columns and len(set(out.columns)) == len(out.columns)
    got = out.collect()
    assert got
    for r in got:
        for c in CLASH:
            assert r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}"


def test_quality_fences_follow_the_group(spark):
    from kinlink.llm.quality import filter_documents

    rng = np.random.default_rng(4)
    text = lambda n, symbols=0, length=5: " ".join("".join(rng.choice(list("abcdefgh"), length)) for _ in range(n - symbols)) + " %%%%%" * symbols
    rows = [(i, text(40), "en", "prose") for i in range(60)] + [(100 + i, text(40, 3 + i % 3), "en", "code") for i in range(60)]
    # The same texts in both; a third of a source is junk; a group of one row is judged as most others are.
    odd = {"symbols": text(40, 4), "long": text(40, 0, 9)}
    rows += [(200, odd["symbols"], "en", "prose"), (201, odd["symbols"], "en", "code"), (202, odd["long"], "en", "prose")]
    rows += [(300 + i, text(40, 0 if i % 3 else 12), "en", "mixed") for i in range(60)] + [(400, odd["symbols"], None, "single")]
    kept = {r.doc_id for r in filter_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert 200 not in kept and 202 not in kept and 201 in kept and 400 not in kept
    assert set(range(60)) <= kept and set(range(100, 160)) <= kept
    assert {i for i in kept if 300 <= i < 400} == {300 + i for i in range(60) if i % 3}


def test_mix(spark, sf, docs):
    from kinlink.llm.mixing import mixed_documents
    from kinlink.llm.queries import op9_mix

    got = op9_mix(spark, sf).collect()
    sizes = [(d, s, measures(t)[0]) for d, t, s in docs]
    total = Counter()
    for _, s, n in sizes:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(total.values()), {}, set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full} if full else share
        left -= sum(2 * total[s] for s in full)
        free = free - full if full else set()
    source = defaultdict(set)
    for d, s, n in sizes:
        source[d, n].add(s)
    taken = Counter()
    for r in got:
        (s,) = source[r.doc_id, r.size]
        assert r.source_size == total[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
    assert len(got) == len(docs)
    for s in order:
        assert abs(taken[s] - target[s]) <= max(n for _, x, n in sizes if x == s)
    key = lambda rs: Counter((r.doc_id, r.taken) for r in rs)
    assert key(got) == key(op9_mix(spark, sf).collect())
    mixed = mixed_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    assert mixed.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    assert mixed.count() == sum(r.taken // r.size for r in got if r.size) + sum(1 for r in mixed.collect() if not (r.text or "").strip())


def test_mix_shards_hold_exact_quotas(spark, sf, docs):
    from pyspark.sql import functions as F

    from kinlink.llm import mixing

    d = spark.read.parquet(f"{sf}/documents.parquet")
    old = mixing.BLOCK, mixing.SHARD
    mixing.BLOCK, mixing.SHARD = 4, 3
    try:
        got = mixing.mixed_shards(d).select("row.doc_id", "row.text", "row.source", "shard").collect()
        taken = {(r.doc_id, r.size): r.taken for r in [x for x in mixing.mix(d, ["doc_id"]).select("row.doc_id", "size", (F.size("shards") * F.col("size")).alias("taken")).collect()]}
        again = mixing.mixed_shards(d.repartition(7)).select("row.doc_id", "shard").collect()
    finally:
        mixing.BLOCK, mixing.SHARD = old
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((r.doc_id, r.shard) for r in again)
    assert len({r.shard for r in got}) > 8
    seen = Counter()
    for r in got:
        n = measures(r.text)[0]
        seen[r.doc_id, n] += n
    repeated = Counter((d_, measures(t)[0]) for d_, t, _ in docs)
    assert all(seen.get(k, 0) == v * repeated[k] for k, v in taken.items())


def test_mix_tree_splits_like_the_hypergeometric(spark):
    from pyspark.sql import functions as F

    from kinlink.llm import mixing

    quotas = [("a", 40), ("b", 7), ("c", 1), ("d", 300)]
    leaves = mixing.shard_quotas(spark.createDataFrame(quotas, "src string, k long"), 348).collect()
    total, per = Counter(), Counter()
    for r in leaves:
        total[r.src] += r.k
        per[r.shard] += r.k
    assert total == Counter(dict(quotas))
    assert max(per.values()) <= mixing.SHARD and max(per.values()) - min(per.values()) <= 1
    # Many draws of one node: mean and variance of the distribution.
    n = 4000
    rows_ = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / float(1 << 52)).alias("u"), F.lit(60).alias("t"), F.lit(25).alias("g"), F.lit(30).alias("d"))
    got = np.array([r[0] for r in rows_.select(mixing._hypergeometric(F.col("t"), F.col("g"), F.col("d"), F.col("u"))).collect()])
    assert abs(got.mean() - 12.5) < 0.15 and abs(got.var() - 30 * 25 / 60 * 35 / 60 * 30 / 59) < 0.4


def near_classes(docs):
    sets, parent = [], {}
    for d, t, _ in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        k = min(5, len(w))
        sets.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter())
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holds = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].add(i)
    pairs = {(i, j) for v in holds.values() if len(v) > 1 for i in v for j in v if i < j}
    for i, j in pairs:
        common = sum((sets[i] & sets[j]).values())
        if common >= 0.8 * (sets[i].total() + sets[j].total() - common):
            parent[i, j] = 1
            root[max(top(i), top(j))] = min(top(i), top(j))
    out = defaultdict(list)
    for i in range(len(docs)):
        out[top(i)].append(docs[i][0])
    return Counter((d, min((x for x in v if x is not None), default=None)) for v in out.values() for d in v)


def test_near_dup(spark, sf, docs):
    from kinlink.llm.neardup import one_of_each
    from kinlink.llm.queries import op10_near_dup

    want = near_classes(docs)
    assert rows(op10_near_dup(spark, sf), "doc_id", "class_id") == want
    kept = one_of_each(spark.read.parquet(f"{sf}/documents.parquet"))
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want}


def test_near_dup_chains(spark):
    from kinlink.llm.neardup import classes

    def edited(words, *at):
        return [f"{w}x{i}" if i in at else w for i, w in enumerate(words)]

    rows = []
    for c in range(60):
        # The base and its copies are similar to a, a to b (0.802), but none of the others to b (0.78 at most).
        base = [f"c{c}w{i}" for i in range(368)]
        a = edited(base, 20)
        texts = [base, *[edited(base, 60 + 10 * k) for k in range(4)], a, edited(a, *range(150, 310, 20))]
        rows += [(c * 10 + k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [d for d, _ in rows if got[d] != d // 10 * 10]
    assert not lost, len(lost)


def joined_rows(spark, after):
    """Rows made by the comparing joins of the executions beyond after, and the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, n, last = spark._jsparkSession.sharedState().statusStore(), 0, after
    runs = store.executionsList().iterator()
    while runs.hasNext():
        if (k := runs.next().executionId()) <= after:
            continue
        last, values, nodes = max(last, k), store.executionMetrics(k), store.planGraph(k).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            if not ("Join" in node.name() and "central" in node.desc() and "leader" in node.desc() and "[value" in node.desc()):
                continue
            metrics = node.metrics().iterator()
            while metrics.hasNext():
                m = metrics.next()
                if m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                    n += int(values.get(m.accumulatorId()).get().replace(",", ""))
    return n, last


def test_near_dup_long_passage_in_common(spark):
    """Texts of similarity 0.69 by a common passage share most buckets, but are not all compared; the similar ones among them are linked."""
    from kinlink.llm.neardup import classes

    passage = [f"p{i}" for i in range(900)]
    texts = [[*passage, *[f"d{d}w{i}" for i in range(200)]] for d in range(120)]
    rows = [(d, " ".join(t)) for d, t in enumerate(texts)] + [(1000 + d, " ".join(t[:-15])) for d, t in enumerate(texts[:20])]
    _, before = joined_rows(spark, -1)
    got = {r.doc_id: r.class_id for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d % 1000 for d, _ in rows}
    made, _ = joined_rows(spark, before)
    assert 20 <= made <= 1000, made


def test_signatures_estimate_weighted_jaccard():
    from kinlink.llm.neardup import signature

    np.seterr(over="ignore")
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    x, y = np.repeat(a, rng.integers(1, 9, 60)), np.repeat(a, rng.integers(1, 9, 60))
    cx, cy = Counter(x.tolist()), Counter(y.tolist())
    true = (cx & cy).total() / (cx | cy).total()
    got = np.mean(signature(x, 4096) == signature(y, 4096))
    assert abs(got - true) < 0.03


def test_line_dedup(spark, sf, docs):
    from kinlink.llm.queries import op6_line_dedup

    s = [(-1, t) if d is None else (d, t) for d, t, _ in docs]
    from kinlink.llm.common import row_key

    keys = Counter()
    order = {(r.doc_id, r.text): r.k for r in spark.read.parquet(f"{sf}/documents.parquet").withColumn("k", row_key("doc_id", "text")).select("doc_id", "text", "k").collect()}
    seen, want = {}, Counter()
    for d, t in sorted(set(s), key=lambda x: (x[0], order[None if x[0] < 0 else x[0], x[1]])):
        lines = (t or "").split("\n")
        real = [(i, x.strip(" \t\n\v\f\r")) for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for i in range(len(real) - 2):
            w = tuple(x for _, x in real[i : i + 3])
            if seen.setdefault(w, (d, t, i)) != (d, t, i):
                gone |= {k for k, _ in real[i : i + 3]}
        text = None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        keys[d, t] = (text, 0 if t is None else len(lines), len(gone))
    for d, t in s:
        want[None if d < 0 else d, *keys[d, t]] += 1
    assert rows(op6_line_dedup(spark, sf), "doc_id", "text", "n_lines", "n_removed") == want


def test_toxicity(spark, sf):
    from kinlink.llm.queries import op4_toxicity

    got = op4_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_held_out(spark):
    from kinlink.llm.queries import op4_toxicity

    at = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = [(r.score, label[r.doc_id]) for r in op4_toxicity(spark, at).collect() if r.held_out and r.doc_id in label]
    pos = np.array([s for s, y in got if y])
    neg = np.array([s for s, y in got if not y])
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    print("AUC", auc, len(pos), len(neg), "recall", (pos >= 0.5).mean(), "false alarms", (neg >= 0.5).mean())
    assert auc > 0.85
    assert (neg >= 0.5).mean() < 0.03


def test_licenses(spark, sf, docs):
    from kinlink.llm.licenses import TEMPLATES, align, license_words, scan
    from kinlink.llm.queries import op1_license_scan

    t = {k: license_words(v) for k, v in TEMPLATES.items()}
    body = t["MIT-text"]
    noisy = ["foo"] * 50 + [w for i, w in enumerate(body) if i % 12] + ["bar"] * 50
    assert [x[2] for x in scan(noisy, t)] == ["MIT-text"]
    assert scan(["mit", "license"] * 40, t) == [] and scan([], t) == []
    assert align(list("abcxdef"), list("abcydef")) == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (6, 6)]
    got = op1_license_scan(spark, sf).collect()
    assert len(got) == len(docs)
    notes = {k: TEMPLATES[k].lower() for k in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0")}
    text = defaultdict(list)
    for d, x, _ in docs:
        text[d].append((x or "").lower())
    for r in got:
        for name, note in notes.items():
            if all(note in x for x in text[r.doc_id]):
                assert name in r.licenses.split(",")
            elif not any("licen" in x for x in text[r.doc_id]):
                assert r.n_licenses == 0


def test_licenses_in_several_copies():
    from kinlink.llm.licenses import TEMPLATES, license_words, scan

    t, rng = {k: license_words(v) for k, v in TEMPLATES.items()}, np.random.default_rng(13)
    filler = [f"w{i}" for i in range(500)]
    for turn in range(150):
        name = list(t)[turn % len(t)]
        body, noisy = t[name], turn % 2 and len(t[name]) > 60
        text, planted = list(rng.choice(filler, rng.integers(0, 60))), []
        for _ in range(rng.integers(1, 4)):
            # Up to a tenth of the words left out, and others put in.
            copy = [x for w in body for x in ([w] if not noisy or rng.random() > 0.04 else []) + ([str(rng.choice(filler))] if noisy and rng.random() < 0.04 else [])]
            planted.append((len(text), len(text) + len(copy)))
            text += [*copy, *rng.choice(filler, rng.choice([0, 0, 1, 5, 80]))]
        got = [x for x in scan(text, t) if x[2] == name]
        assert len(got) == len(planted), (name, planted, got)
        for (a, z), (b, y, _, coverage) in zip(planted, got, strict=True):
            assert min(z, y) - max(a, b) >= 0.8 * (z - a) and coverage >= (0.8 if noisy else 1.0)
    assert scan(t["CC-BY-NC-4.0"] * 3, t) and {x[2] for x in scan(t["CC-BY-SA-4.0"], t)} == {"CC-BY-SA-4.0"}


def test_simple8b_round_trip():
    from kinlink.llm.tokens import pack_block, unpack_block

    rng = np.random.default_rng(3)
    for n in (1, 2, 59, 240, 241, 511, 512, 513, 5000):
        for high in (1, 2, 9, 50_257, 1 << 20, 1 << 33, 1 << 50):
            ids = rng.integers(0, high, n).astype(np.uint64)
            ids[rng.integers(0, n)] = 1 << 62
            assert unpack_block(pack_block([ids, ids[:3]]))[1].tolist() == [*ids.tolist(), *ids[:3].tolist()]


def test_queries_give_the_rows_of_their_sql(spark):
    import glob
    import os

    import duckdb

    from kinlink.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    value = lambda x: None if x != x or x is None else x.item() if hasattr(x, "item") else x
    for name, sql in ORACLE.items():
        got, want = QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        counted = lambda d: Counter(tuple(None if x is None or str(x) in ("<NA>", "nan") else int(x) if isinstance(x, float) else value(x) for x in r) for r in d[cols].itertuples(index=False))
        assert counted(got) == counted(want), name


def test_empty_tables(spark, tmp_path):
    from kinlink.llm.queries import QUERIES

    for name in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, f in QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = d
        d = f(spark, d, sf)
        assert d.columns == before.columns, name
        d.write.parquet(path := f"{sf}/stage-{name}")
        d = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, sf).count() == d.count() > 0


@pytest.mark.parametrize("few", [200_000, 0])
def test_components(spark, monkeypatch, few):
    """A root is the least node of its component, on both ways; few links take few jobs, however long their chain is."""
    from kinlink.llm import neardup

    monkeypatch.setattr(neardup, "FEW_LINKS", few)
    r = np.random.default_rng(7)
    name = lambda i: hashlib.md5(str(i).encode()).digest()
    links = [(i, i + 1) for i in range(120)] + [tuple(p) for p in r.integers(1000, 1400, (300, 2)).tolist()] + [(5, 5), (3, 2)]
    root = {}
    for a, b in links:
        joined = root.get(a, {a}) | root.get(b, {b})
        root.update(dict.fromkeys(joined, joined))
    edges = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in links], "a binary, b binary")
    spark.sparkContext.setJobGroup(f"components-{few}", "")
    got = {bytes(x.node): bytes(x.root) for x in neardup.components(edges).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {name(i): min(map(name, every)) for i, every in root.items()}
    if few:
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{few}")) <= 6
        assert neardup.components(edges.filter("a is null")).count() == 0
