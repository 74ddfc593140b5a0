"""Readers of the text formats of the field, as DataFrames with an order that does not depend on partitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Three-letter residue names. Fixed values.
RESIDUE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def _text(spark: SparkSession, paths: str | list[str], sep: str | None = None) -> DataFrame:
    """value, file, ord: records in file order; ord is (start of the split, number within its task)."""
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    return reader.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord")
    )


def fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """id, description, seq, file, ord of each record; large files are split over tasks.

    id is the first word of the header; a record without letters has an empty seq; text before
    the first header, as in a file without any, is no record.
    """
    rows = _text(spark, paths, "\n>")
    # Only the head of a file still has its own mark; one without it is no record.
    head = rows.groupBy("file").agg(F.min("ord").alias("ord")).withColumn("_head", F.lit(True))
    rows = rows.join(head, ["file", "ord"], "left").where(F.col("_head").isNull() | F.col("value").startswith(">"))
    body = F.regexp_replace("value", r"^>", "")
    header = F.trim(F.regexp_replace(F.substring_index(body, "\n", 1), "\r", ""))
    seq = F.when(F.instr(body, "\n") > 0, F.regexp_replace(F.expr(r"substr(regexp_replace(value, '^>', ''), instr(regexp_replace(value, '^>', ''), '\n') + 1)"), r"\s+", "")).otherwise("")
    return rows.where(header != "").select(F.regexp_extract(header, r"^(\S+)", 1).alias("id"), header.alias("description"), seq.alias("seq"), "file", "ord")


def first_of_each(records: DataFrame, key: str = "seq") -> DataFrame:
    """The first record, by file and order, of each sequence (by its md5)."""
    first = F.struct("file", "ord")
    kept = records.columns
    return records.groupBy(F.md5(key).alias("_h")).agg(F.min_by(F.struct(*kept), first).alias("r")).select("r.*")


def last_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each non-blank trimmed key."""
    kept = rows.columns
    return rows.withColumn("_k", F.trim(key)).where("_k <> ''").groupBy("_k").agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("r")).select("r.*")


def pdb_atoms(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """structure, chain, resseq, ord, resname, aa, x, y, z, b of the CA atoms, by the format's fixed columns.

    A residue number that is none drops the line, a temperature factor that is none is 0, an
    unknown residue is X. structure is the file's name without its ending.
    """
    part = lambda a, n: F.trim(F.substring("value", a, n))
    number = lambda a, n, kind: F.expr(f"try_cast(trim(substr(value, {a}, {n})) as {kind})")
    rows = _text(spark, paths).where(F.col("value").startswith("ATOM") & (part(13, 4) == "CA"))
    names = F.create_map(*[F.lit(x) for kv in RESIDUE.items() for x in kv])
    return rows.select(
        F.regexp_extract("file", r"([^/]+?)(?:\.pdb)?$", 1).alias("structure"), F.substring("value", 22, 1).alias("chain"), number(23, 4, "int").alias("resseq"), "ord", part(18, 3).alias("resname"),
        F.coalesce(F.element_at(names, part(18, 3)), F.lit("X")).alias("aa"), number(31, 8, "double").alias("x"), number(39, 8, "double").alias("y"), number(47, 8, "double").alias("z"),
        F.coalesce(number(61, 6, "double"), F.lit(0.0)).alias("b"),
    ).where("resseq is not null")


def chain_sequences(atoms: DataFrame) -> DataFrame:
    """structure, chain, seq by residue number; the first atom of a residue counts."""
    once = atoms.groupBy("structure", "chain", "resseq").agg(F.min_by("aa", "ord").alias("aa"))
    return once.groupBy("structure", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("resseq", "aa"))), lambda r: r["aa"]), "").alias("seq"))


def vcf_calls(spark: SparkSession, paths: str | list[str], gene: str, min_depth: int | None = None) -> DataFrame:
    """sample, position, ref, alt, depth: calls other than 0/0 in records whose first GENE is the given one.

    min_depth: None keeps every depth. Lines with too few columns are left out.
    """
    lines = _text(spark, paths).where(~F.col("value").startswith("##")).withColumn("c", F.split("value", "\t"))
    names = lines.where(F.col("value").startswith("#CHROM")).select("file", F.slice("c", F.lit(10), F.greatest(F.size("c") - 9, F.lit(0))).alias("names"))
    rows = lines.where(~F.col("value").startswith("#") & (F.size("c") >= 10)).join(names, "file")
    info = F.expr("str_to_map(c[7], ';', '=')")
    rows = rows.where(F.split(F.element_at(info, "GENE"), ",")[0] == gene)
    each = rows.select("names", F.col("c")[1].cast("int").alias("position"), F.col("c")[3].alias("ref"), F.split(F.col("c")[4], ",")[0].alias("alt"), F.split(F.col("c")[8], ":").alias("keys"), F.posexplode(F.slice("c", F.lit(10), F.size("c") - 9)).alias("i", "call"))
    value = lambda k: F.get(F.split("call", ":"), F.array_position("keys", k).cast("int") - 1)
    out = each.select(F.get("names", F.col("i")).alias("sample"), "position", "ref", "alt", value("GT").alias("gt"), F.expr("try_cast(get(split(call, ':'), cast(array_position(keys, 'DP') as int) - 1) as int)").alias("depth"))
    out = out.where("gt is not null and gt not in ('0/0', '0|0')")
    if min_depth is not None:
        out = out.where(F.col("depth") >= min_depth)
    return out.select("sample", "position", "ref", "alt", "depth")


def domain_table(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """seq_id, domains: per sequence the array of (domain, signature, start, end, evalue) of a tab-separated scan, in file order.

    Blank and # lines, lines with under nine columns and those whose places are no numbers are left out.
    """
    rows = _text(spark, paths).where(~F.col("value").startswith("#")).withColumn("c", F.split("value", "\t", -1)).where("size(c) >= 9")
    rows = rows.withColumn("start", F.expr("try_cast(c[6] as int)")).withColumn("end", F.expr("try_cast(c[7] as int)")).where("start is not null and end is not null")
    sig, text = F.trim(F.col("c")[4]), F.trim(F.col("c")[5])
    domain = F.when(text != "", F.concat(sig, F.lit(" ("), text, F.lit(")"))).otherwise(sig)
    one = F.struct("file", "ord", F.struct(domain.alias("domain"), sig.alias("signature"), "start", "end", F.trim(F.col("c")[8]).alias("evalue")).alias("d"))
    return rows.groupBy(F.col("c")[0].alias("seq_id")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["d"]).alias("domains"))


def wide_matrix(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """A matrix as text columns, its label column (by default the first) as `cancer`, with row_ord in file order."""
    m = spark.read.csv(path, header=True)
    label = label or m.columns[0]
    return m.withColumnRenamed(label, "cancer").withColumn("row_ord", F.monotonically_increasing_id())


def stacked_blocks(spark: SparkSession, path: str) -> DataFrame:
    """block, line_no, cells of a CSV file that stacks several tables: a table ends with an empty line, its first line is its header (line_no 0).

    Meant for one hand-made file; its lines are ordered together.
    """
    lines = _text(spark, path).withColumn("cells", F.split("value", ",", -1))
    lines = lines.withColumn("empty", F.regexp_replace("value", "[,\\s]", "") == "")
    order = Window.partitionBy("file").orderBy("ord")
    rows = lines.withColumn("_b", F.sum(F.col("empty").cast("int")).over(order)).where("not empty")
    rows = rows.withColumn("block", F.dense_rank().over(Window.partitionBy("file").orderBy("_b")))
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("file", "block").orderBy("ord")) - 1).select("file", "block", "line_no", "cells")


def latest_file(spark: SparkSession, pattern: str, by_name: bool = False) -> str | None:
    """Path of the newest file of a pattern, or the last by name; None if there is none."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    best = files.orderBy(F.desc("path" if by_name else "modificationTime"), F.desc("path")).limit(1).collect()
    return best[0]["path"] if best else None


def fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """id, base_id, seq, qual, file, read_no of FASTQ files, which Spark reads from any of its file systems, large ones in splits.

    Lines are numbered in their file by the counts of the splits before, and four of them make a
    read, wherever the splits fall; an incomplete last read is left out.
    """
    rows = _text(spark, paths).select("value", "file", F.col("ord.block").alias("block"), F.col("ord.row").alias("row"))
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A split is read by one task in order, so the numbers of its rows have no gaps.
    line = rows.join(sizes.withColumn("before", before).drop("n"), ["file", "block"]).withColumn("line", F.col("before") + F.col("row") - F.col("first"))
    at = lambda i: F.max(F.when(F.col("line") % 4 == i, F.regexp_replace("value", "\r$", "")))
    reads = line.groupBy("file", F.expr("line div 4").alias("read_no")).agg(at(0).alias("head"), at(1).alias("seq"), at(3).alias("qual")).where("qual is not null")
    read_id = F.regexp_extract("head", r"^@?(\S*)", 1)
    return reads.select(read_id.alias("id"), F.regexp_replace(read_id, r"[./][12]$", "").alias("base_id"), "seq", "qual", "file", "read_no")


class FastqSource(DataSource):
    """Reads of FASTQ files, plain or gzip: id, base_id, seq, qual, file, ord. One task per file, record by record; option path: files joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "id string, base_id string, seq string, qual string, file string, ord long"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options["path"].split(","))


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FastqReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [FilePart(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import gzip
        import re
        from itertools import islice

        opened = gzip.open if partition.path.endswith(".gz") else open
        with opened(partition.path, "rt") as f:
            n = 0
            while len(four := list(islice(f, 4))) == 4:
                head, seq, _, qual = (x.rstrip("\r\n") for x in four)
                words = head[1:].split()
                read_id = words[0] if words else ""
                yield read_id, re.sub(r"[./][12]$", "", read_id), seq, qual, partition.path, n
                n += 1


def reads_of_hits(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """All reads, both mates, of which either mate is a hit. hits: id."""
    base = hits.select(F.regexp_replace("id", r"[./][12]$", "").alias("base_id")).distinct()
    return reads.join(base, "base_id", "left_semi")
