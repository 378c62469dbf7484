"""Round trips of files."""

import bz2
import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pairloom import cli
from pairloom.operators import report
from pairloom.sources import bam, bundle, clusterings, fasta


def block(raw: bytes) -> bytes:
    """One BGZF block."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    extra = struct.pack("<BBHH", 66, 67, 2, len(body) + 25)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def bam_bytes(refs, records, order="queryname"):
    text = f"@HD\tVN:1.6\tSO:{order}\n".encode()
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    for name, size in refs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    body = b""
    for name, flag, refid, pos, mapq, cigar in records:
        ops = b"".join(struct.pack("<I", n << 4 | op) for op, n in cigar)
        own = struct.pack("<iiBBHHHiiii", refid, pos, len(name) + 1, mapq, 0, len(cigar), flag, 0, -1, -1, 0) + name.encode() + b"\0" + ops
        body += struct.pack("<i", len(own)) + own
    raw = head + body
    return b"".join(block(raw[k : k + 700]) for k in range(0, len(raw), 700)) + block(b"")


def test_bam(spark, tmp_path):
    records = [(f"r{k // 2}", 16 * (k % 2), k % 3, 10 * k, 60, [(0, 30), (4, 5)] if k % 5 else []) for k in range(200)]
    path = str(tmp_path / "x.bam")
    open(path, "wb").write(bam_bytes([("a", 5000), ("b", 6000), ("c", 10)], records))
    whole = bam.read_bam(spark, path).sort("rec_no").collect()
    for size in (150, 400, 1111, 5000):
        assert bam.read_bam(spark, path, size).sort("rec_no").collect() == whole
    got = whole
    assert [(r["qname"], r["flag"], r["refid"], r["pos"], r["mapq"], [(c["op"], c["len"]) for c in r["cigar"]]) for r in got] == records
    assert [tuple(r) for r in bam.bam_references(spark, path).sort("refid").collect()] == [(0, "a", 5000), (1, "b", 6000), (2, "c", 10)]
    open(path, "wb").write(bam_bytes([("a", 5000)], [], "coordinate"))
    with pytest.raises(OSError):
        bam.bam_references(spark, path)


def long_records(rng, n, sizes):
    """Raw records with bases and qualities, and now and then a read of one of the sizes."""
    body, names = b"", []
    for k in range(n):
        bases = sizes[k] if k in sizes else rng.randrange(0, 60)
        name, ops = f"read{k}".encode(), struct.pack("<I", bases << 4) if bases else b""
        own = struct.pack("<iiBBHHHiiii", k % 3, 10 * k, len(name) + 1, 60, 0, bool(bases), 0, bases, -1, -1, 0) + name + b"\0" + ops
        own += bytes(rng.choices(b"\x11\x12\x48\x84", k=(bases + 1) // 2)) + bytes(rng.choices(range(42), k=bases))
        body += struct.pack("<i", len(own)) + own
        names.append(name.decode())
    return body, names


@pytest.mark.parametrize("search", [4 << 20, 3000])
def test_splits_of_long_reads_lose_nothing(tmp_path, monkeypatch, search):
    """Splits that lie within a read, hold only its tail, or begin with it; also where no first record is found and records are counted."""
    monkeypatch.setattr(bam, "SEARCH_BYTES", search)
    rng = random.Random(5)
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 3) + b"".join(struct.pack("<i", 2) + x + b"\0" + struct.pack("<i", 10**6) for x in (b"a", b"b", b"c"))
    for sizes in ({3: 300_000, 400: 90_000}, {599: 200_000}, {0: 150_000}):
        body, names = long_records(rng, 600, sizes)
        raw = head + body
        path = str(tmp_path / f"{len(raw)}-{search}.bam")
        open(path, "wb").write(b"".join(block(raw[k : k + 5000]) for k in range(0, len(raw), 5000)) + block(b""))
        whole = [r for b in bam._Reader(path, 1 << 30).read(bam._Reader(path, 1 << 30).partitions()[0]) for r in b.to_pylist()]
        assert [r["qname"] for r in whole] == names
        for size in (2000, 7777, 60_000):
            reader = bam._Reader(path, size)
            parts = reader.partitions()
            assert len(parts) > 2
            assert [r for p in parts for b in reader.read(p) for r in b.to_pylist()] == whole


def test_sam(spark, tmp_path):
    path = str(tmp_path / "x.sam")
    open(path, "w").write("@HD\tVN:1.6\tSO:queryname\n@SQ\tSN:a\tLN:500\n@SQ\tSN:b\tLN:600\nr1\t0\tb\t11\t60\t10M2S\t*\t0\t0\t*\t*\nr1\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    refs = bam.sam_references(spark, path)
    got = bam.read_sam(spark, path, refs).sort("rec_no").collect()
    assert [(r["qname"], r["flag"], r["refid"], r["pos"], [(c["op"], c["len"]) for c in r["cigar"]]) for r in got] == [("r1", 0, 1, 10, [(0, 10), (4, 2)]), ("r1", 4, -1, -1, [])]


FASTA = ">a first > one\nACGT\nacgtNN\n>b\n\nRYK\n>c empty\n"


@pytest.mark.parametrize("suffix,pack", [("", lambda b: b), (".gz", gzip.compress), (".bz2", bz2.compress), (".GZ", gzip.compress)])
def test_fasta(spark, tmp_path, suffix, pack):
    path = str(tmp_path / f"x.fa{suffix}")
    open(path, "wb").write(pack(FASTA.encode()))
    got = sorted(tuple(r) for r in fasta.read_fasta(spark, path).collect())
    assert got == [("a", "a first > one", "ACGTacgtNN", 10), ("b", "b", "RYK", 3), ("c", "c empty", "", 0)]


def test_memberships(spark, tmp_path):
    p = str(tmp_path / "m")
    open(p, "w").write("a b\nc\n\nd\n")
    assert sorted(tuple(r) for r in clusterings.read_mcl(spark, p).collect()) == [(0, "a"), (0, "b"), (1, "c")]
    open(p, "w").write("# x\n1:1 0.5 \"n\" 7\n1:2 0.1 \"n\" 3\n2:1 0.2 \"m\" 5\n")
    assert sorted(tuple(r) for r in clusterings.read_tree(spark, p).collect()) == [(0, "3"), (0, "7"), (1, "5")]
    open(p, "w").write("s1 4\ns2 4\ns3 9\n")
    assert sorted(tuple(r) for r in clusterings.read_cluster_table(spark, p).collect()) == [("4", "s1"), ("4", "s2"), ("9", "s3")]
    e = spark.createDataFrame([("a", "b", 2.0), ("b", "b", 0.5)], "u string, v string, weight double")
    clusterings.write_graphml(e, p + ".graphml")
    assert sorted(tuple(r) for r in clusterings.read_graphml(spark, p + ".graphml").collect()) == [("a", "b", 2.0), ("b", "b", 0.5)]
    clusterings.write_edges(e, p + ".edges")
    assert sorted(tuple(r) for r in clusterings.read_edges(spark, p + ".edges").collect()) == [("a", "b", 2.0), ("b", "b", 0.5)]


def test_cluster_fasta(spark, tmp_path):
    dim = spark.createDataFrame([(0, "x", 130), (1, "y", 60)], "ix int, name string, length int")
    seqs = spark.createDataFrame([("x", "A" * 130), ("y", "C" * 60)], "seq_name string, seq string")
    members, clusters = report.ranked(spark.createDataFrame([(0, 0), (0, 1)], "cl_id int, ix int"), dim)
    out = str(tmp_path / "fasta")
    assert bundle.write_cluster_fasta(report.fasta_records(members, clusters, dim, seqs), out) == 1
    assert open(f"{out}/CL1.fna").read() == f">CL1_1 contig:x ori:UNKNOWN length:130\n{'A' * 60}\n{'A' * 60}\n{'A' * 10}\n>CL1_2 contig:y ori:UNKNOWN length:60\n{'C' * 60}\n"
    with pytest.raises(FileExistsError):
        bundle.write_cluster_fasta(report.fasta_records(members, clusters, dim, seqs), out)


def test_relative_paths_and_stores(spark, tmp_path, monkeypatch):
    """Plain relative paths, as in the README, and URIs as Spark writes them."""
    from pairloom.sources import stores

    monkeypatch.chdir(tmp_path)
    assert stores.absolute("x/y") == f"file://{tmp_path}/x/y" == stores.absolute(f"file:{tmp_path}/x/y") == stores.absolute(f"file://{tmp_path}/x/y")
    assert stores.absolute("s3a://bucket/x") == "s3://bucket/x" and stores.file_system("a%20b#c")[1] == f"{tmp_path}/a%20b#c"
    open("r.bam", "wb").write(bam_bytes([("a", 5000)], [("q", 0, 0, 1, 60, [(0, 30)])]))
    assert bam.bam_references(spark, "r.bam").count() == 1 and bam.read_bam(spark, "r.bam").count() == 1
    rows = spark.createDataFrame([("CL1", 1, "CL1_1", "d", "ACGT")], "name string, rank int, record_id string, description string, seq string")
    assert bundle.write_cluster_fasta(rows, "out/fasta") == 1 and open("out/fasta/CL1.fna").read() == ">CL1_1 d\nACGT\n"


def test_fragments_keep_the_order_of_the_file(spark, tmp_path):
    path = str(tmp_path / "x.fa")
    open(path, "w").write("".join(f">{n}\n{'ACGT' * 5}\n" for n in ("zz", "b", "a10", "a9")))
    assert cli.main(["split", "-s", "10", path]) == 0
    heads = [r["value"] for r in spark.read.text(f"{path}.split").where("value LIKE '>%'").collect()]
    assert [h.split(".")[0] for h in heads] == [">zz", ">zz", ">b", ">b", ">a10", ">a10", ">a9", ">a9"]


def test_sites_and_communities(spark, tmp_path):
    from pairloom.operators import sequences

    assert sequences.enzyme("G^ANTC").site == "GANTC" and sequences.enzyme("g^antc").cut == 1 and sequences.enzyme("HinfI").site == "GANTC"
    # the heaviest edge of a is its loop, so a belongs to no further community; z has a loop only
    open(tmp_path / "e", "w").write("a a 5\na b 1\nb c 2\nc d 9\na x 4\nx y 9\nz z 50\n")
    for flag, has_z in (("--no-isolates", False), ("--ragbag", True)):
        assert cli.main(["communities", "--ifmt", "edgelist", "--otype", "maxaff", flag, str(tmp_path / "e"), str(tmp_path / f"o{flag}")]) == 0
        lines = [r["value"].split() for r in spark.read.text(str(tmp_path / f"o{flag}")).collect()]
        assert sum("a" in x for x in lines) == 1 and any("z" in x for x in lines) == has_z


def test_command_line(spark, tmp_path):
    rng = random.Random(2)
    names = [f"NODE_{k}_length_{3000}_cov_{k}.5" for k in range(12)]
    open(tmp_path / "x.fa", "w").write("".join(f">{n}\n{''.join(rng.choice('ACGT') for _ in range(3000))}\n" for n in names))
    records = []
    for k in range(1500):
        a = rng.randrange(12)
        b = rng.choice([x for x in range(12) if x // 4 == a // 4]) if rng.random() < 0.97 else rng.randrange(12)
        records += [(f"r{k:05}", 65, a, rng.randrange(2900), 60, [(0, 50)]), (f"r{k:05}", 129, b, rng.randrange(2900), 60, [(0, 50)])]
    open(tmp_path / "x.bam", "wb").write(bam_bytes([(n, 3000) for n in names], records))
    assert cli.main(["mkmap", "-e", "MluCI", "--bin-size", "1000", str(tmp_path / "x.fa"), str(tmp_path / "x.bam"), str(tmp_path / "map")]) == 0
    assert cli.main(["cluster", "--seed", "1", "--min-extent", "5000", "--fasta", str(tmp_path / "x.fa"), str(tmp_path / "map"), str(tmp_path / "out")]) == 0
    clusters = spark.read.parquet(str(tmp_path / "out/clustering/clusters"))
    assert sorted(tuple(r) for r in clusters.select("name", "size", "extent").collect()) == [("CL1", 4, 12000), ("CL2", 4, 12000), ("CL3", 4, 12000)]
    picture = (tmp_path / "out/cluster_plot.png").read_bytes()
    assert picture[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", picture[16:24]) == (36, 36)
    pixels = zlib.decompress(picture[41 : 41 + struct.unpack(">I", picture[33:37])[0]])
    assert len(pixels) == 36 * 37 and sum(pixels[37 * k + 1 + k] for k in range(36)) < sum(pixels[37 * k + 36 - k] for k in range(36))  # the diagonal is dark
    table = spark.read.option("header", True).csv(str(tmp_path / "out/cluster_report.csv"))
    assert table.count() == 3 and "cov_std" in table.columns
    # a map with bins shows its bins: three of each contig
    assert spark.read.parquet(str(tmp_path / "out/cluster_tiles")).select(F.max("i")).first()[0] == 35
    ticks = spark.read.parquet(str(tmp_path / "out/cluster_ticks")).sort("tick").collect()
    assert [r["tick"] for r in ticks] == [0, 12, 24, 36]
    assert cli.main(["split", "-s", "1000", str(tmp_path / "x.fa")]) == 0
    assert fasta.count_records(spark, str(tmp_path / "x.fa.split")) == 36
