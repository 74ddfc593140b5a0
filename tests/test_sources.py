"""Readers, writers, providers and streams on small files."""

import gzip
import os

from pyspark.sql import functions as F

from seqloom.sources import files, providers, sinks
from seqloom.streaming import loop
from tests.conftest import rows


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    a = write(tmp_path / "a.fasta", ">r1 first > one\nACD\nEFG\n>r2\n\n>r3\r\nAC*\r\n")
    b = write(tmp_path / "b.fasta", "no header\nACDEFG\n")
    c = write(tmp_path / "c.fasta", "junk\n>r4\nACDEFG\n")
    got = {r["id"]: (r["description"], r["seq"]) for r in files.fasta(spark, [a, b, c]).collect()}
    assert got == {"r1": ("r1 first > one", "ACDEFG"), "r2": ("r2", ""), "r3": ("r3", "AC*"), "r4": ("r4", "ACDEFG")}
    assert files.fasta(spark, b).count() == 0
    assert {r["id"] for r in files.first_of_each(files.fasta(spark, [a, b, c])).collect()} == {"r1", "r2", "r3"}


def test_fasta_split_over_tasks(spark, tmp_path):
    n = 3000
    p = write(tmp_path / "big.fasta", "".join(f">s{i}\n{'ACDEF' * (i % 7)}\n{'G' * (i % 3)}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = files.fasta(spark, p)
        got = [(r["id"], r["seq"]) for r in df.orderBy("file", "ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(f"s{i}", "ACDEF" * (i % 7) + "G" * (i % 3)) for i in range(n)]


def test_write_fasta(spark, tmp_path):
    df = spark.createDataFrame([("a", "C" * 130), ("b", ""), ("c", None)], "id string, seq string")
    sinks.write_fasta(df, str(tmp_path / "out"), 60)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert ">a\n" + "C" * 60 + "\n" + "C" * 60 + "\n" + "C" * 10 + "\n" in text
    assert dict(rows(files.fasta(spark, str(tmp_path / "out")).select("id", "seq"))) == {"a": "C" * 130, "b": ""}


def atom(res, chain, n, x, b="90.00", name=" CA "):
    return f"ATOM  {n:>5} {name} {res} {chain}{n:>4}    {x:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{b:>6}"


def test_pdb(spark, tmp_path):
    text = [atom("MET", "A", 2, 1), atom("GLY", "A", 1, 2, "xx"), atom("ALA", "A", 2, 9), atom("ALA", "A", 3, 9, name=" CB "), atom("UNK", "B", 1, 3), atom("HIS", "B", 5, 3), "HETATM", "ATOM      9  CA  GLY A  zz    "]
    df = files.pdb_atoms(spark, write(tmp_path / "x.pdb", "\n".join(text)))
    assert df.select("structure").distinct().collect()[0][0] == "x"
    assert sorted(rows(files.chain_sequences(df).select("chain", "seq"))) == [("A", "GM"), ("B", "XH")]
    assert df.where("resseq = 1 and chain = 'A'").collect()[0]["b"] == 0.0
    lines = files._text(spark, str(tmp_path / "x.pdb"))
    assert sinks.pdb_slice(lines, 2, 3, "A").count() == 3


def test_vcf(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
    body = "1\t10\t.\tA\tT,G\t.\t.\tGENE=KRAS,X;Z=1\tGT:DP\t0/1:7\t0/0:3\n1\t11\t.\tC\tG\t.\t.\tGENE=TP53\tGT:DP\t1/1:9\t1/1:9\n1\t12\t.\tC\tG\t.\t.\tGENE=KRAS\tDP:GT\t2:1/1\t.:0/1\n1\t13\n"
    p = write(tmp_path / "v.vcf", head + body)
    assert sorted(rows(files.vcf_calls(spark, p, "KRAS"))) == [("s1", 10, "A", "T", 7), ("s1", 12, "C", "G", 2), ("s2", 12, "C", "G", None)]
    assert files.vcf_calls(spark, p, "KRAS", 5).count() == 1


def test_domains_and_matrices(spark, tmp_path):
    p = write(tmp_path / "d.tsv", "# c\n\nq\tm\t9\tPfam\tPF1\tfold\t3\t9\t1e-5\nq\tm\t9\tPfam\tPF2\t\t1\t2\t0.1\tx\nq\tm\t9\tP\tPF3\tz\tno\t2\t0\nshort\tx\n")
    d = files.domain_table(spark, p).collect()
    assert len(d) == 1 and [(x["domain"], x["start"]) for x in d[0]["domains"]] == [("PF1 (fold)", 3), ("PF2", 1)]
    m = files.wide_matrix(spark, write(tmp_path / "m.csv", "Cancer,f1,f2\nA,1,2\n,3,4\n"))
    assert m.columns == ["cancer", "f1", "f2", "row_ord"] and m.where("cancer is null").count() == 1
    s = files.stacked_blocks(spark, write(tmp_path / "s.csv", "C,f1\nA,1\n,\n\nC,g1\nB,2\nD,3\n"))
    assert sorted(rows(s.select("block", "line_no", F.col("cells")[0]))) == [(1, 0, "C"), (1, 1, "A"), (2, 0, "C"), (2, 1, "B"), (2, 2, "D")]


def test_latest(spark, tmp_path):
    a, b = write(tmp_path / "x_2.fasta", "a"), write(tmp_path / "x_1.fasta", "b")
    os.utime(a, (1, 1))
    assert files.latest_file(spark, str(tmp_path / "x_*.fasta")).endswith("x_1.fasta") and b
    assert files.latest_file(spark, str(tmp_path / "x_*.fasta"), by_name=True).endswith("x_2.fasta")


def test_fastq_and_mates(spark, tmp_path):
    p = tmp_path / "r.fastq"
    p.write_text("@r1.1 x\nACGT\n+\n@III\n@r2/1\nGG\n+\nII\n@r1.2\nTT\n+\nII\n")
    with gzip.open(tmp_path / "z.fastq.gz", "wt") as f:
        f.write("@q\nA\n+\nI\n@broken\nA\n")
    spark.dataSource.register(files.FastqSource)
    reads = spark.read.format("fastq").option("path", f"{p},{tmp_path / 'z.fastq.gz'}").load()
    assert sorted(rows(reads.select("id", "base_id", "ord"))) == [("q", "q", 0), ("r1.1", "r1", 0), ("r1.2", "r1", 2), ("r2/1", "r2", 1)]
    hits = spark.createDataFrame([("r1.2",)], "id string")
    assert {r["id"] for r in files.reads_of_hits(reads, hits).collect()} == {"r1.1", "r1.2"}


def test_providers(spark):
    def factory():
        def model(seqs):
            if any("Z" in s for s in seqs):
                raise ValueError
            return [[float(len(s))] for s in seqs]

        return model

    df = spark.createDataFrame([(1, "A" * 49), (2, "A" * 50), (3, "A" * 2000), (4, "Z" * 60), (5, None)], "id long, seq string").coalesce(1)
    assert dict(rows(providers.embedded(df, "id", "seq", factory, batch=1))) == {2: [50.0], 3: [1000.0], 4: None}

    class Numbers(providers.PagedSearch):
        @staticmethod
        def searcher(term, offset, limit):
            if offset == 20:
                raise OSError
            return [f"{term}{i}" for i in range(offset, offset + limit)]

        @classmethod
        def name(cls):
            return "numbers"

    spark.dataSource.register(Numbers)
    got = spark.read.format("numbers").option("term", "t").option("total", "25").option("page", "10").load()
    assert sorted(r["offset"] for r in got.collect()) == list(range(20))


def test_streams(spark, tmp_path):
    spark.createDataFrame([(i, f"k{i % 30}" if i % 7 else None) for i in range(200)], "o long, k string").repartition(5).write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("k1",), (None,)], "k string")
    df = loop.stream(spark, str(tmp_path / "in"), 1)
    out = loop.mine(df, "k", "o", known, str(tmp_path / "mine")).collect()
    assert sorted(r["k"] for r in out) == sorted({f"k{i}" for i in range(30)} - {"k1"}) and len({r["batch"] for r in out}) > 1
    assert loop.distinct_keys(loop.stream(spark, str(tmp_path / "in"), 2), "k", str(tmp_path / "dis")).count() == 30
    ev = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) as ts, 'a' as e, 1.0 as v from range(150)")
    ev.write.parquet(str(tmp_path / "ev"))
    w = loop.windowed(loop.stream(spark, str(tmp_path / "ev")), "ts", "e", "v", "1 hour", "5 minutes", str(tmp_path / "w"))
    assert sorted(r["n"] for r in w.collect()) == [30, 60, 60]
