"""Operator 3: personal data by fixed shapes and bootstrapped contextual extraction.

Base spans come from four fixed patterns. They seed the bootstrap: the two words before a seed, of any length, are
a lexical pattern. Identifier-like words and patterns form a bipartite graph. In each round a pattern's score
is the share of its occurrences, over all words it stands before in all documents, that are known
identifiers (at least SUPPORT different ones), and a word's score is the noisy-or of its patterns. Words that
reach CONFIDENCE are discovered; from then on they induce patterns wherever else they stand. It ends when a round discovers
nothing, after ROUNDS rounds at most. A discovered word is a span where a pattern of CONFIDENCE stands before it.
Base spans always stay; discovered ones never overlap them.

An identifier-like word is what SHAPE says: a digit, an @, an underscore or a dot between letters in it, and SHORTEST characters
or more without the signs at its ends. Others are never discovered, as plain words behind a pattern would be.

Everything is DataFrame functions; counts are combined before each shuffle. Occurrences are counted for contexts of
SUPPORT different known words, which alone are patterns: first over the documents that can hold identifiers, and then, for the
contexts whose share can still reach LEAST, over all; patterns of a smaller share don't count.
Contexts are told apart by 64 bits, documents and words by 128.

Defined results: null text is empty: no spans, hash of ""; rows equal in doc_id and text are counted
as one in the graph and get the same spans each; texts of any length are read whole; an empty table gives an empty result; extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, row_key, stage, words

ROUNDS = 8
SUPPORT = 3
SHORTEST = 5
CONFIDENCE = 0.8
LEAST = 0.2
KINDS = ("email", "ip", "card", "phone")
#: The four fixed patterns. Possessive where nothing after could use what is given back; a run is entered at its
#: start or where the last match ended (\G), so that long runs take linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]++)++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests for texts that can hold a kind.
POSSIBLE = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}
#: A word between white space with a sign of an identifier in it; entered at its start only.
SHAPE = r"(?<!\S)\S*?(?:[0-9@_]|(?<=[A-Za-z])\.(?=[A-Za-z]))\S*+"
#: Matches whose places are summed together.
CHUNK = 256
_SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        def digit(i: Column) -> Column:
            x = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return F.when(x > 9, x - 9).otherwise(x)

        return F.length(d).between(14, 19) & (F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), digit), F.lit(0), lambda a, x: a + x) % 10 == 0)

    return let(F.regexp_replace(m, r"[\x20-]", ""), total)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        n = F.length(F.regexp_replace(m, "[^0-9]", ""))
        return F.when(n.between(14, 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str) -> Column:
    """Structs of each match and the text between it and the one before."""
    none = F.expr("cast(array() as array<struct<gap:string,m:string>>)")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, F.zip_with(m, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda a, g: F.struct(g.alias("gap"), a.alias("m")))).otherwise(none))


def _placed(matches: Column) -> Column:
    """The end of each match in code points. Sums are made in chunks, as growing one long array would take quadratic time."""
    size = lambda x: F.length(x["gap"]) + F.length(x["m"])

    def running(values: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(values, zero, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"] + v)).alias("out")), lambda a: a["out"])

    def ends(sizes: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda c: F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK)))
        sums = lambda cs: running(F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v)), F.lit(0))
        return let(chunks, lambda cs: let(sums(cs), lambda upto: F.flatten(F.transform(cs, lambda c, i: running(c, F.coalesce(F.get(upto, i - 1), F.lit(0)))))))

    return F.when(F.size(matches) == 0, F.expr("cast(array() as array<int>)")).otherwise(let(F.transform(matches, size), ends))


def spans(text: Column, pattern: str, rank: int) -> Column:
    """Matches with their places in code points."""
    at = lambda m: F.zip_with(m, _placed(m), lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["m"].alias("value")))
    return let(_matches(text, pattern), at)


def base_spans(text: Column) -> Column:
    """Valid spans of the fixed patterns, by start, then kind."""
    none = F.expr(f"cast(array() as {_SPAN})")

    def one(rank: int, kind: str) -> Column:
        return F.when(POSSIBLE[kind](text), F.filter(spans(text, PATTERNS[kind], rank), lambda s: _valid(kind, s["value"]))).otherwise(none)

    return F.array_sort(F.concat(*[one(i, k) for i, k in enumerate(KINDS)]))


def _context(first: Column, second: Column) -> Column:
    return F.xxhash64(F.concat(F.lower(first), F.lit(" "), F.lower(second)))


def identifier_words(text: Column) -> Column:
    """Structs of start, end, value (128 bits) and ctx (of the two words before) of the identifier-like words behind two others."""

    def word(m: Column, ends: Column) -> Column:
        part = lambda i, f: F.coalesce(F.get(m, i)[f], F.lit(""))

        def one(x: Column, i: Column) -> Column:
            # Of the text before, what holds two words: the match before the last, and all since.
            before = words(F.concat(part(i - 2, "m"), part(i - 1, "gap"), part(i - 1, "m"), x["gap"]))
            start = F.get(ends, i) - F.length(x["m"])
            ctx = let(before, lambda w: F.when(F.size(w) >= 2, _context(F.element_at(w, -2), F.element_at(w, -1))))
            left = F.length(F.regexp_extract(x["m"], r"^[^A-Za-z0-9+]*+", 0))
            core = F.regexp_replace(x["m"], r"^[^A-Za-z0-9+]++|(?<=[A-Za-z0-9])[^A-Za-z0-9]++$", "")
            return F.struct((start + left).alias("start"), (start + left + F.length(core)).alias("end"), F.unhex(F.md5(core)).alias("value"), ctx.alias("ctx"))

        return F.filter(F.transform(m, one), lambda t: t["ctx"].isNotNull() & (t["end"] - t["start"] >= SHORTEST))

    return let(_matches(text, SHAPE), lambda m: let(_placed(m), lambda ends: word(m, ends)))


def pair_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """ctx, n: how often the wanted pairs of words stand before a third, in all documents; rows of one key count once. docs: key, text.

    Each of several rows of a key counts for its share, so that counts are summed in every task before the shuffle."""
    copies = docs.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("key").alias("of"), "c")
    w = words(F.col("text"))
    pairs = let(w, lambda a: F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - 2, F.lit(0))), lambda x, i: _context(x, F.get(a, i + 1))))
    each = docs.join(copies, F.col("key") == F.col("of"), "left").select(F.coalesce(1 / F.col("c"), F.lit(1.0)).alias("share"), F.explode(pairs).alias("ctx"))
    return each.join(wanted, "ctx", "left_semi").groupBy("ctx").agg(F.round(F.sum("share")).cast("long").alias("n"))


def _counted(docs: DataFrame, wanted: DataFrame, before: DataFrame | None) -> DataFrame:
    """ctx, n of before and of the wanted contexts that it lacks."""
    new = stage(wanted if before is None else wanted.join(before, "ctx", "left_anti"), "contexts")
    if before is not None and new.isEmpty():
        return before
    more = stage(pair_counts(docs, new), "counts")
    return more if before is None else before.unionByName(more)


def discover(held: DataFrame, every: DataFrame) -> DataFrame:
    """key, start, end, rank of the words that the bootstrap adds. held: key, base, found (identifier-like words); every: key, text of all."""
    one = stage(held.filter(F.size("found") > 0).select("key", "base", "found").dropDuplicates(["key"]), "found")
    base = one.select("key", F.explode("base").alias("b")).select("key", F.col("b.start").alias("start"), F.col("b.rank").alias("kind")).groupBy("key", "start").agg(F.min("kind").alias("kind"))
    toks = stage(one.select("key", F.explode("found").alias("t")).select("key", "t.*").join(base, ["key", "start"], "left"), "words")
    known = stage(toks.select("value", "kind").filter("kind is not null").distinct(), "known")
    # Texts that can hold identifiers: how often a pattern occurs there bounds its share from above.
    some = every.filter(F.col("text").rlike("[0-9@_]"))
    bounds = counted = None
    for _ in range(ROUNDS):
        marked = stage(toks.select("ctx", "value").join(known, "value").groupBy("ctx", "kind").agg(F.count("*").alias("hits"), F.countDistinct("value").alias("seeds")).filter(F.col("seeds") >= SUPPORT), "marked")
        bounds = _counted(some, marked.select("ctx").distinct(), bounds)
        likely = marked.join(bounds, "ctx").filter(F.col("hits") >= LEAST * F.col("n")).select("ctx").distinct()
        counted = _counted(every, likely, counted)
        share = F.least(F.col("hits") / F.greatest("n", "hits"), F.lit(0.999))
        pattern = stage(marked.join(counted, "ctx").select("ctx", "kind", share.alias("p")).filter(F.col("p") >= LEAST), "patterns")
        graph = toks.filter("kind is null").select("value", "ctx").distinct().join(pattern, "ctx")
        score = graph.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("score"))
        best = score.filter(F.col("score") >= CONFIDENCE).groupBy("value").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))
        discovered = stage(best.join(known, "value", "left_anti"), "new")
        if discovered.isEmpty():
            break
        known = stage(known.unionByName(discovered), "known")
    found = toks.filter("kind is null").drop("kind").join(pattern.filter(F.col("p") >= CONFIDENCE), "ctx").join(known, ["value", "kind"])
    return found.groupBy("key", "start", "end").agg(F.min("kind").alias("rank"))


def _joined(s: Column) -> Column:
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
    return F.concat(name, F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and all: arrays of spans (start, rank of the kind, end) of every row of docs."""
    d = docs.select("doc_id", row_key("doc_id", "text").alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    slim = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    held = stage(d.select("doc_id", "key", slim(base_spans(F.col("text"))).alias("base"), identifier_words(F.col("text")).alias("found")), "base")
    more = stage(discover(held, d.select("key", "text")), "discovered").groupBy("key").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more")).withColumnRenamed("key", "of")
    out = held.select("doc_id", "key", "base").join(more, F.col("key") == F.col("of"), "left")
    apart = F.filter("more", lambda m: ~F.exists("base", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    return out.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", apart))).alias("all"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts and hash of the base spans, all spans as text."""
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(F.array_join(F.transform("base", _joined), ","), 256).alias("base_sha256"), F.array_join(F.transform("all", _joined), ",").alias("spans"))
