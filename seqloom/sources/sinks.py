"""Writers of the text formats of the field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.protein import wrapped


def write_fasta(records: DataFrame, path: str, width: int | None = None, mode: str = "errorifexists") -> None:
    """`>id`, then the sequence in one line or in lines of a width. Null sequences are left out."""
    seq = wrapped("seq", width) if width else F.col("seq")
    records.where("id is not null and seq is not null").select(F.concat(F.lit(">"), "id", F.lit("\n"), seq).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, *order, single: bool = False) -> None:
    """With header; in order, and as one file, if told (for small reports)."""
    out = df.orderBy(*order) if order else df
    (out.coalesce(1) if single else out).write.csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """id and embedding as parquet."""
    df.select("id", "embedding").write.parquet(path)


def pdb_slice(atom_lines: DataFrame, first: int, last: int, chain: str | None = None) -> DataFrame:
    """value of the ATOM lines whose residue number is from first to last, in file order. atom_lines: value, ord."""
    number = F.expr("try_cast(trim(substr(value, 23, 4)) as int)")
    rows = atom_lines.where(F.col("value").startswith("ATOM") & number.between(first, last))
    if chain is not None:
        rows = rows.where(F.substring("value", 22, 1) == chain)
    return rows.orderBy("ord").select("value")
