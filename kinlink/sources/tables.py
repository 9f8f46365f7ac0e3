"""TSV, checkpoint and configuration sources and sinks, and records derived from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = ("entity_id", "business_name", "business_address", "country")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def resolve_input(spark: SparkSession, folder: str, name: str, fallback: str | None = None) -> str:
    """The path of name in folder, or else in fallback."""
    for at in (folder, fallback):
        if at and exists(spark, f"{at}/{name}"):
            return f"{at}/{name}"
    raise FileNotFoundError(f"{name} is in neither of {folder} and {fallback}")


def files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a path, by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(at)
    return sorted(str(f.getPath().toString()) for f in found if f.isFile() and (f.getPath().toString() == path or not f.getPath().getName().startswith(("_", "."))))


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file, or of the first that has one in a folder."""
    for f in files(spark, path):
        if (row := spark.read.text(f).first()) is not None:
            return row["value"]
    return None


def with_pos(df: DataFrame, path: str) -> DataFrame:
    """df, a file source's rows, with pos: their order in the file, or in the files by name."""
    names = files(df.sparkSession, path)
    if len(names) > 1000:
        raise ValueError("give the order of rows in more than a thousand files by a column of their own")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    file = F.array_position(F.array(*[F.lit(n.rsplit("/", 1)[-1]) for n in names]), F.col("_metadata.file_name")) - 1
    block = F.floor(F.col("_metadata.file_block_start") / (1 << 20)).cast("long")
    return df.select("*", (F.shiftleft(file, 53) + F.shiftleft(block, 33) + row).alias("pos"))


def _csv(spark: SparkSession):
    return spark.read.option("sep", "\t").option("escape", '"').option("nullValue", "\x00").option("encoding", "UTF-8")


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None, order: bool = False) -> DataFrame:
    """All columns as strings; an empty field is an empty string and NA stays NA. Lines that repeat the header, as at the
    start of each part file, are no rows. order: with a column pos."""
    line = first_line(spark, path)
    if line is None:
        raise ValueError(f"{path} is empty")
    names = [c.strip() for c in line.split("\t")]
    d = _csv(spark).schema(", ".join(f"`{c}` string" for c in names)).csv(path)
    d = (with_pos(d, path) if order else d).fillna("")
    same = F.lit(True)
    for c in names:
        same = same & (F.btrim(f"`{c}`") == c)
    return d.filter(~same).select(*[f"`{c}`" for c in columns or names], *["pos"] * order)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with pos, their order in the file; ids are trimmed."""
    return read_tsv(spark, path, list(RECORD), True).withColumn("entity_id", F.btrim("entity_id")).filter("entity_id <> ''")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    d = read_tsv(spark, path)
    ids = F.filter(F.transform(F.split("matched_entity_ids", ","), lambda x: F.btrim(x)), lambda x: x != "")
    return d.withColumn("match_list", ids).withColumn("match_count", F.size("match_list"))


def truth_sets(truth: DataFrame) -> DataFrame:
    """source1_entity_id and its matches as a set: a sorted array without repeats."""
    return truth.select("source1_entity_id", F.array_sort(F.array_distinct("match_list")).alias("matches"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    return truth_sets(truth).select("source1_entity_id", F.explode("matches").alias("candidate_entity_id"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """entity_id: the different first fields of a file's lines, without the header and blank lines."""
    lines = with_pos(spark.read.text(path), path)
    return lines.filter((F.btrim("value") != "") & (F.col("pos") != 0)).select(F.btrim(F.split("value", "\t")[0]).alias("entity_id")).distinct()


def read_candidates(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """source1_entity_id, pos in its list, candidate_entity_id of a file of lists; with known (source1_entity_id) only of known records."""
    ids = F.filter(F.transform(F.split("candidate_entity_ids", ","), lambda x: F.btrim(x)), lambda x: x != "")
    d = read_tsv(spark, path, ["source1_entity_id", "candidate_entity_ids"])
    d = d if known is None else d.join(known.select("source1_entity_id"), "source1_entity_id", "left_semi")
    return d.select("source1_entity_id", F.posexplode(ids).alias("pos", "candidate_entity_id"))


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """source1_entity_id, candidate_entity_ids, matched_entity_ids, pos of headerless rows; a header inside is skipped, short rows are filled, the last row of an id stays."""
    schema = "source1_entity_id string, candidate_entity_ids string, matched_entity_ids string"
    d = with_pos(_csv(spark).schema(schema).csv(path), path).fillna("").select(*[F.btrim(c).alias(c) for c in ("source1_entity_id", "candidate_entity_ids", "matched_entity_ids")], "pos")
    d = d.filter(~F.col("source1_entity_id").isin("", "source1_entity_id"))
    return last_of_each(d, "pos", "source1_entity_id")


def _quoted(c: str) -> Column:
    s = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.when(s.rlike('[\\t\\n\\r"]'), F.concat(F.lit('"'), F.regexp_replace(s, '"', '""'), F.lit('"'))).otherwise(s)


def write_tsv(df: DataFrame, path: str, order: str | None = None, header: bool = True) -> None:
    """Tab-separated text, quoted only where it must be, without order. With it the rows follow that column through all
    part files, whose texts put together, by name, are one file with one header line."""
    columns = [c for c in df.columns if c != order]
    line = F.concat_ws("\t", *[_quoted(c) for c in columns])
    rows = df.select(F.lit(1).alias("k"), (F.col(order) if order else F.lit(0)).cast("long").alias("o"), line.alias("value"))
    if header:
        rows = rows.unionByName(df.sparkSession.createDataFrame([(0, 0, "\t".join(columns))], "k int, o long, value string"))
    # Sorted over all partitions by range: the header, of the least key, begins the first part.
    (rows.orderBy("k", "o") if order or header else rows).select("value").write.mode("overwrite").text(path)


def last_of_each(records: DataFrame, order: str = "pos", key: str = "entity_id") -> DataFrame:
    """Of rows with one key the last."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return records.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def union_targets(*sources: DataFrame) -> DataFrame:
    """Records of all sources; of one id that of the latest source, and there the last."""
    every = [last_of_each(d).withColumn("_source", F.lit(i)) for i, d in enumerate(sources)]
    out = every[0]
    for d in every[1:]:
        out = out.unionByName(d)
    return last_of_each(out, "_source").drop("_source")


def explode_lists(lists: DataFrame, column: str, keep_empty: bool = True) -> DataFrame:
    """source1_entity_id, candidate_entity_id, source; a record without candidates gives a row with an empty one."""
    ids = F.filter(F.split(column, ","), lambda x: x != "")
    e = lists.select("source1_entity_id", (F.explode_outer if keep_empty else F.explode)(ids).alias("candidate_entity_id")).fillna("")
    return e.withColumn("source", F.when(F.col("candidate_entity_id").startswith("S2-"), "S2").otherwise("S3"))


def load_config(path: str) -> dict:
    import yaml

    with open(path) as f:  # FileNotFoundError where there is none
        return yaml.safe_load(f) or {}


def resume(source: DataFrame, done: DataFrame) -> DataFrame:
    """Records that a checkpoint does not hold yet."""
    return source.join(done.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_anti")


def first_records(records: DataFrame, limit: int | None) -> DataFrame:
    """The first limit records by pos."""
    return records.orderBy("pos").limit(limit) if limit else records


def business_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three sources made of all documents: entity_id, name, address, country, pos, source, truth_key."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    d = d.withColumn("w", w).withColumn("no", F.size("w"))
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % len(xs)).cast("int") + 1)
    country = F.when(F.col("doc_id") % 17 == 0, "").when(F.col("lang") == "en", pick(["USA", "US"])).when(F.col("lang") == "fr", "FR").when(F.col("lang") == "de", "Germany").otherwise("Spain")
    return d.select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.concat_ws(" ", F.slice("w", 1, 3), pick(["Inc", "Pvt Ltd", "LLC", "GmbH", "Co", "Group"])).alias("business_name"),
        F.concat_ws(" ", F.col("no").cast("string"), F.slice("w", 4, 2), pick(["St", "Rd", "Ave", "Blvd"]), F.lpad((F.col("no") * 37 % 100000).cast("string"), 5, "0")).alias("business_address"),
        country.alias("country"), F.col("doc_id").alias("pos"), F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string")).alias("source"),
        F.concat_ws(" ", F.slice("w", 6, 12)).alias("truth_key"), "no",
    )
