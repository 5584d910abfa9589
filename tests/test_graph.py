"""The junction graph against a plain Python model, over seeded random genomes and edge cases."""

import gzip
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from junctura.functions import dna
from junctura.operators import junctions, neighbours, packed, ranking, segments, windows
from junctura.plans import catalog, formats, writers
from junctura.plans.graph import JunctionGraph
from junctura.sources import fasta, gfa, junction_file, positional, sequences

PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}


def rc(s):
    return "".join(PAIR.get(c, "N") for c in reversed(s))


def genomes(seed, n=4, length=300, gaps=0.004):
    """A random sequence and mutated copies of it, one of them on the other strand."""
    rng = random.Random(seed)
    first = "".join("N" if rng.random() < gaps else rng.choice("ACGT") for _ in range(length))
    out = [first]
    for _ in range(n - 1):
        copy = []
        for c in first:
            x = rng.random()
            if x < 0.01:
                copy.append(rng.choice("ACGT"))
            elif x < 0.03:
                copy += [c, rng.choice("ACGT")]
            elif x >= 0.05:
                copy.append(c)
        out.append("".join(copy))
    return [*out[:-1], rc(out[-1])]


def model(seqs, k, abundance=None):
    """(canonical junctions, positions marked in each sequence): every unknown neighbour is a letter of its own."""
    before, after, count, unknown = defaultdict(set), defaultdict(set), Counter(), iter(range(10**9))
    for s in seqs:
        for i in range(len(s) - k + 1):
            kmer = s[i : i + k]
            if set(kmer) <= set("ACGT"):
                a = s[i - 1] if i and s[i - 1] in PAIR else next(unknown)
                b = s[i + k] if i + k < len(s) and s[i + k] in PAIR else next(unknown)
                before[kmer].add(a)
                after[kmer].add(b)
                before[rc(kmer)].add(PAIR.get(b, b))
                after[rc(kmer)].add(PAIR.get(a, a))
                count[min(kmer, rc(kmer))] += 1
    found = {min(x, rc(x)) for x in before if len(before[x]) > 1 or len(after[x]) > 1}
    found = {x for x in found if abundance is None or count[x] <= abundance}
    marks = [sorted({i for i in range(len(s) - k + 1) if min(s[i : i + k], rc(s[i : i + k])) in found} | ({0, len(s) - k} if len(s) >= k else set())) for s in seqs]
    return found, marks, count


def table(spark, seqs):
    rows = [(i, f"h{i}", s, len(s)) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "seq_id long, header string, seq string, length long")


EDGE_CASES = [
    ["", "ACG", "ACGT", "ACGTA", "ACGTAC"],
    ["ACGTACCA", "ACGTATTT"],
    ["NNACGTTGCANNGGATCCNN", "TGCAACGT"],
    ["AAAAAAAAAAAA", "TTTTTTTT"],
    ["ACGTTGCAACGTTGCA", "NNNNNNNN"],
]


@pytest.mark.parametrize(("seqs", "k"), [*((genomes(s), k) for s, k in ((1, 3), (2, 5), (3, 7), (4, 9))), *((e, 5) for e in EDGE_CASES)])
def test_junctions_and_positions(spark, seqs, k):
    graph = JunctionGraph(table(spark, seqs), k)
    found, marks, count = model(seqs, k)
    ids = {r.ck: r.id for r in graph.junctions.collect()}
    assert ids == {x: i for i, x in enumerate(sorted(found), 1)}
    assert {r.ck: r.n for r in graph.vertices.collect()} == count
    rows = graph.positions.orderBy("seq_id", "pos").collect()
    got, stubs = [[] for _ in seqs], []
    for r in rows:
        got[r.seq_id].append(r.pos)
        kmer = seqs[r.seq_id][r.pos : r.pos + k]
        if min(kmer, rc(kmer)) in found:
            assert r.junction_id == (ids[kmer] if kmer in ids else -ids[rc(kmer)])
        else:
            stubs.append(r.junction_id)
    assert got == marks and stubs == list(range(len(found) + 42, len(found) + 42 + len(stubs)))


@pytest.mark.parametrize("k", [3, 9])
def test_large_random_genomes(spark, k):
    """Six genomes of some 9,000 letters, unknown ones among them, of which five are changed copies of the first."""
    rng = random.Random(k)
    seqs = ["".join("N" if rng.random() < 1 / 500 else rng.choice("ACGT") for _ in range(9000))]
    for _ in range(5):
        copy = []
        for c in seqs[0]:
            if rng.random() >= 0.05:
                copy.append(c)
            elif rng.random() < 0.1:
                copy.append(rng.choice("ACGT"))
            elif rng.random() < 0.5:
                copy += [c, rng.choice("ACGT")]
        seqs.append("".join(copy))
    graph = JunctionGraph(table(spark, seqs), k)
    found, marks, _ = model(seqs, k)
    placed = defaultdict(list)
    for r in graph.positions.collect():
        placed[r.seq_id].append(r.pos)
    assert {r.ck for r in graph.junctions.collect()} == found and [sorted(placed[i]) for i in range(6)] == marks
    again = junctions.by_extended_kmers(graph.occurrences).where(junctions.is_junction())
    assert {r.ck for r in again.collect()} == found


def test_strands_and_order_do_not_matter(spark):
    seqs = genomes(8)
    keys = {r.ck for r in JunctionGraph(table(spark, seqs), 7).junctions.collect()}
    assert keys == {r.ck for r in JunctionGraph(table(spark, [rc(s) for s in reversed(seqs)]), 7).junctions.collect()}
    twice = {r.kmer for r in junctions.both_strands(JunctionGraph(table(spark, seqs), 7).occurrences).collect()}
    assert twice == keys | {rc(x) for x in keys}


def test_abundance(spark):
    seqs = genomes(5)
    got = {r.ck for r in JunctionGraph(table(spark, seqs), 5, abundance=3).junctions.collect()}
    assert got == model(seqs, 5, 3)[0]


def test_short_chunks_give_the_same_windows(spark):
    own = table(spark, [*genomes(6), "ACGT", ""])
    for k in (3, 9):
        whole = sorted(map(tuple, windows.kmers(own, k).collect()))
        assert whole == sorted(map(tuple, windows.kmers(own, k, size=7).collect()))


def test_paths_spell_their_sequences(spark):
    for seqs, k in ((genomes(7, gaps=0), 7), (genomes(9, gaps=0), 9)):
        graph = JunctionGraph(table(spark, seqs), k)
        spelled = {r.seq_id: r.seq for r in fasta.whole(segments.respelled(graph.paths, graph.segments, k)).collect()}
        assert spelled == {i: s for i, s in enumerate(seqs) if len(s) > k}
        assert segments.overlaps(graph.links, graph.segments, k).first().violations == 0
        bodies = [r.body for r in graph.segments.collect()]
        assert len(bodies) == len(set(bodies))


def test_reserved_segments_are_unique(spark):
    graph = JunctionGraph(table(spark, genomes(2, gaps=0.02)), 5)
    ids = [r.segment_id for r in graph.pieces.orderBy("seq_id", "begin").collect() if r.segment_id >= segments.RESERVED]
    assert ids == list(range(segments.RESERVED, segments.RESERVED + len(ids))) and ids


def test_formats(spark):
    seqs = ["ACGTACCATTGACGTAGG", "TTACCATTGACCA"]
    graph = JunctionGraph(table(spark, seqs), 5)
    lines = lambda fmt, **x: [r.line for r in graph.lines(fmt, **x).orderBy(*writers.ORDER).collect()]
    one, two = lines("gfa1"), lines("gfa2", prefix=True)
    assert one[0] == "H\tVN:Z:1.0" and one[1] == "S\th0\t*\tUR:Z:documents" and two[0] == "H\tVN:Z:2.0"
    kinds = lambda x: Counter(line[0] for line in x)
    assert kinds(one)["C"] == kinds(two)["F"] and kinds(one)["L"] == kinds(two)["E"] and kinds(one)["S"] == kinds(two)["S"] + 2
    assert two[-1].startswith("O\ts1_h1p\t") and one[-1].startswith("P\th1\t") and one[-1].endswith("\t*")
    dot = lines("dot")
    assert dot[0].startswith("digraph G") and dot[-1] == "}" and sum("blue" in x for x in dot) == sum("red" in x for x in dot)
    groups = [x.split("; ")[:-1] for x in lines("group")]
    assert sorted(p for g in groups for p in g) == sorted(" ".join(x.split()[:2]) for x in lines("seq"))
    for record in lines("fasta"):
        assert record[0] == ">" and max(map(len, record.split("\n")[1:])) <= 80
    with pytest.raises(ValueError):
        graph.lines("bam")


def key(df):
    return sorted(tuple(r) for r in df.select("seq_id", "pos", "junction_id").collect())


def test_junction_file(spark, tmp_path):
    seqs = ["AC", *genomes(3)[:2], "G", "", genomes(3)[2]]
    placed = JunctionGraph(table(spark, seqs), 5).positions
    path = tmp_path / "out.bin"
    size = junction_file.write(placed, str(path))
    expected, at = [], 0
    for seq_id, pos, junction in key(placed):
        expected += [(junction_file.SEPARATOR_POS, junction_file.SEPARATOR_ID)] * (seq_id - at) + [(pos, junction)]
        at = seq_id
    assert path.read_bytes() == b"".join(pos.to_bytes(4, "little") + junction.to_bytes(8, "little", signed=True) for pos, junction in expected) and size == 12 * len(expected)
    assert [x.name for x in tmp_path.iterdir() if x.name.endswith(".part")] == []
    for records in (1, 7, 1000):
        assert key(junction_file.read(spark, str(path), range_records=records)) == key(placed)
    marked = {r.seq_id: r.marks for r in junction_file.marks(junction_file.read(spark, str(path)), table(spark, seqs)).collect()}
    assert [marked[i] for i in range(len(seqs))] == model(seqs, 5)[1]
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(Exception, match="whole records"):
        junction_file.read(spark, str(path)).collect()


def test_empty_junction_file(spark, tmp_path):
    path = str(tmp_path / "none.bin")
    assert junction_file.write(JunctionGraph(table(spark, ["AC"]), 5).positions, path) == 0
    assert junction_file.read(spark, path).count() == 0


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one two > three\nacgt\nNNRY\n\n>two\nAC GT>three\r\nTT\r\n")
    (tmp_path / "b.fa").write_text(">four\n")
    (tmp_path / "c.fa.gz").write_bytes(gzip.compress(b">five\nAC\nGT\n>\nTT"))
    expected = [(0, "a.fa", "one", "ACGTNNRY"), (1, "a.fa", "two", "ACGT"), (2, "a.fa", "three", "TT"), (3, "b.fa", "four", ""), (4, "c.fa.gz", "five", "ACGT"), (5, "c.fa.gz", "", "TT")]
    for size in (3, 1 << 20):
        got = fasta.whole(fasta.read_fasta(spark, *(str(tmp_path / x) for x in ("a.fa", "b.fa", "c.fa.gz")), range_bytes=size)).orderBy("seq_id").collect()
        assert [(r.seq_id, r.file, r.header, r.seq) for r in got] == expected and all(r.length == len(r.seq) for r in got)
        for bad in (">x\nAC1T\n", "ACGT\n>x\nA\n"):
            (tmp_path / "bad.fa").write_text(bad)
            with pytest.raises(Exception, match="(?s)invalid letter|opens with"):
                fasta.read_fasta(spark, str(tmp_path / "bad.fa"), range_bytes=size).collect()
    with pytest.raises(FileNotFoundError):
        fasta.read_fasta(spark, str(tmp_path / "none.fa"))


def test_ranges_of_any_size_give_the_same_records(spark, tmp_path):
    rng, records = random.Random(4), []
    for i in range(12):
        letters = "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 5, 60, 400])))
        records.append((f"r{i}" + "x" * rng.randrange(30), letters))
    text = "".join(f">{h} some > words {i}\n" + (s + "\n" if i % 3 else "\n".join(s[j : j + 17] for j in range(0, len(s), 17)) + ">mid\n" * (i == 6) + "\n") for i, (h, s) in enumerate(records))
    (tmp_path / "a.fa").write_text(text)
    records.insert(7, ("mid", ""))
    for size in (16, 50, 5000):
        pieces = fasta.read_fasta(spark, str(tmp_path / "a.fa"), range_bytes=size).collect()
        by_record = defaultdict(list)
        for r in pieces:
            by_record[r.seq_id].append((r.start, r.seq, r.length, r.header))
        assert len(by_record) == len(records)
        for n, (header, letters) in enumerate(records):
            parts = sorted(by_record[n])
            assert "".join(p[1] for p in parts) == letters and {p[2:] for p in parts} == {(len(letters), header)}
            assert [p[0] for p in parts] == [sum(len(x[1]) for x in parts[:i]) for i in range(len(parts))]


@pytest.mark.parametrize("line", [70, 0])
def test_a_large_record_is_work_for_many_tasks(spark, tmp_path, line):
    """A record on short lines, or on a single one: no row has more than a piece of it, no range all of it."""
    letters = "".join(random.Random(1).choices("ACGT", k=3_000_000))
    (tmp_path / "large.fa").write_text(">large\n" + ("\n".join(letters[i : i + line] for i in range(0, len(letters), line)) if line else letters) + "\n")
    pieces = fasta.read_fasta(spark, str(tmp_path / "large.fa"), range_bytes=1 << 18).cache()
    found = pieces.agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("most"), F.max("length").alias("length"), F.count_if(F.length("seq") == 0).alias("empty")).first()
    assert found.n >= 46 and found.most <= fasta.PIECE and found.length == len(letters) and not found.empty
    assert "".join(r.seq for r in pieces.orderBy("start").collect()) == letters
    placed = JunctionGraph(pieces, 13).positions.groupBy().agg(F.count("*").alias("n"), F.sum("pos").alias("s")).first()
    assert tuple(placed) == tuple(JunctionGraph(table(spark, [letters]), 13).positions.agg(F.count("*"), F.sum("pos")).first())


def in_pieces(spark, seqs, size):
    rows = [(i, f"h{i}", at, s[at : at + size], len(s)) for i, s in enumerate(seqs) for at in range(0, max(1, len(s)), size)]
    return spark.createDataFrame(rows, "seq_id long, header string, start long, seq string, length long")


@pytest.mark.parametrize(("k", "size", "span"), [(5, 7, 3), (11, 50, 6)])
def test_pieces_and_ranges_of_positions_change_nothing(spark, monkeypatch, k, size, span):
    """All formats of sequences in short pieces, with windows over short ranges, tiles and runs, are those of whole ones."""
    seqs = [*genomes(6, gaps=0.01), "ACGT", "", "ACGTACGTAAC", genomes(11, n=1, length=40, gaps=0)[0] * 30]
    whole = JunctionGraph(table(spark, seqs), k)
    expected = {fmt: text(whole, fmt) for fmt in writers.names()}
    with monkeypatch.context() as m:
        for where, name, value in ((neighbours, "SPAN_BITS", span), (segments, "TILE", 32), (segments, "SHARED", 8), (windows, "CHUNK", 16), (formats, "RUN_BITS", 1)):
            m.setattr(where, name, value)
        parts = JunctionGraph(in_pieces(spark, seqs, size), k)
        assert {fmt: text(parts, fmt) for fmt in writers.names()} == expected
        assert parts.paths.count() > whole.paths.count()
        gapless = [i for i, s in enumerate(seqs) if "N" not in s and len(s) > k]
        spelled = segments.respelled(parts.paths, parts.segments, k)
        assert spelled.agg(F.max(F.length("seq"))).first()[0] < 1200
        assert {r.seq_id: r.seq for r in fasta.whole(spelled).collect() if r.seq_id in gapless} == {i: seqs[i] for i in gapless}


def text(graph, fmt):
    rows = graph.lines(fmt).orderBy(*writers.ORDER).collect()
    return "".join(r.line if r.open else r.line + "\n" for r in rows)


@pytest.mark.parametrize("version", [1, 2])
def test_gfa_files_are_read_back(spark, tmp_path, version):
    from junctura import cli

    seqs = [*genomes(7, gaps=0), "ACGTACGTAACCAGT", genomes(3, n=1, gaps=0)[0]]
    graph, path = JunctionGraph(table(spark, seqs), 7), tmp_path / "x.gfa"
    graph.write(f"gfa{version}", str(path), prefix=True)
    back = gfa.read(spark, str(path))
    assert (back.version, back.k) == (version, 7) and back.segments.count() == graph.segments.count()
    links = graph.links.count()
    assert tuple(gfa.overlaps(back).first()) == (links, 0)
    assert {r.header: r.seq for r in fasta.whole(gfa.spelled(back)).collect()} == {f"s{i}_h{i}": s for i, s in enumerate(seqs)}
    cli.main(["spell", "-o", str(tmp_path / "x.fa"), str(path)])
    again = {r.header: r.seq for r in fasta.whole(fasta.read_fasta(spark, str(tmp_path / "x.fa"))).collect()}
    assert again == {f"s{i}_h{i}": s for i, s in enumerate(seqs)}
    # A changed letter at either end of a body: one of them is shared by a link.
    lines = path.read_text().split("\n")
    n = next(i for i, x in enumerate(lines) if x.startswith("S\t") and "*" not in x)
    head, _, body = lines[n].rpartition("\t")
    lines[n] = f"{head}\t{PAIR[body[0]]}{body[1:-1]}{PAIR[body[-1]]}"
    path.write_text("\n".join(lines))
    assert gfa.overlaps(gfa.read(spark, str(path))).first().violations > 0
    with pytest.raises(SystemExit, match="differ"):
        cli.main(["spell", "-o", str(tmp_path / "y.fa"), str(path)])
    path.write_text("\n".join([*lines, lines[n]]))
    with pytest.raises(Exception, match="twice"):
        gfa.read(spark, str(path)).segments.collect()


def test_ranks_of_equal_prefixes(spark):
    rows = spark.range(5000).select(F.concat(F.lit("AAAAAAAAAAAAAAAAAAAA"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("key"), "id")
    found = ranking.ranked(rows, ["key"], "rank")
    assert found.where("rank <> id + 1").count() == 0 and found.count() == 5000
    counts = [r["count"] for r in ranking.ordered(rows, ["key"]).groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) > 1 and max(counts) < 2 * sum(counts) / len(counts)


@pytest.mark.parametrize("k", [1, 3, 11, 25, 31])
def test_numbers_of_windows(spark, k):
    seqs = [*genomes(k, gaps=0.01), "", "ACG", "A" * 60, "RYACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTK"]
    own = table(spark, seqs)
    graph = JunctionGraph(own, k)
    strings = graph.occurrences.select("seq_id", "pos", dna.packed(F.col("ck")).alias("code"), "forward", *[dna.letter_code(F.col(c)).alias(c) for c in ("prev", "next")])
    numbers = packed.occurrences(own, k).select("seq_id", "pos", "code", "forward", *[F.when(F.col(c) == packed.UNKNOWN, -1).otherwise(F.col(c)).cast("long").alias(c) for c in ("prev", "next")])
    assert sorted(map(tuple, numbers.collect())) == sorted(map(tuple, strings.collect()))
    assert sorted(map(tuple, graph.vertices.collect())) == sorted(map(tuple, junctions.vertices(graph.occurrences).collect()))


@pytest.mark.parametrize("merged", [1 << 21, 50])
def test_runs_of_a_minimizer_count_each_kmer_once(spark, monkeypatch, merged):
    monkeypatch.setattr(packed, "MERGED", merged)
    seqs = [*genomes(3, gaps=0.01), *genomes(3, gaps=0.01)[:2], "A" * 2000, "T" * 900, "ACGT" * 300]
    own = table(spark, seqs)
    for k in (17, 25, 31):
        assert sorted(map(tuple, JunctionGraph(own, k).vertices.collect())) == sorted(map(tuple, junctions.vertices(JunctionGraph(own, k).occurrences).collect()))
    letters = np.frombuffer(seqs[0].replace("N", "A").encode(), np.uint8)
    other = np.frombuffer(rc(seqs[0].replace("N", "A")).encode(), np.uint8)
    assert (packed.minimizers(letters, 25) == packed.minimizers(other, 25)[::-1]).all()


def test_rounds_bound_what_is_aggregated_at_a_time(spark):
    own = table(spark, genomes(5, length=3000))
    found, sizes = packed.degrees_in_rounds(own, 7, 64, 4)
    whole = sorted(map(tuple, packed.degrees(own, 7).collect()))
    assert sorted(tuple(r)[:4] for r in found.collect()) == whole
    assert sum(sizes) == len(whole) and len(sizes) == 4 and max(sizes) < 1.5 * len(whole) / 4
    assert packed.degrees_in_rounds(own.limit(0), 7, 64, 4)[0].count() == 0


def test_long_kmers_are_keyed_by_letters(spark):
    seqs = genomes(4, gaps=0.001)
    graph = JunctionGraph(table(spark, seqs), 33)
    found, marks, _ = model(seqs, 33)
    assert {r.ck for r in graph.junctions.collect()} == found
    with pytest.raises(ValueError):
        packed.occurrences(graph.sequences, 33)


def test_what_is_counted_while_tables_are_written(spark):
    seqs = genomes(5)
    graph = JunctionGraph(table(spark, seqs), 5)
    found, marks, count = model(seqs, 5)
    assert graph.positions.count() == sum(map(len, marks))
    real = sum(count[x] for x in found)
    assert graph.counted == {"true_junctions": len(found), "false_junctions": len(count) - len(found), "table_size": len(count), "kmers": sum(count.values()), "marks": real, "positions": sum(map(len, marks))}


def test_a_format_can_be_added(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "_FORMATS", dict(writers._FORMATS))

    @writers.register
    class Bed(writers.Format):
        name = "bed"

        def lines(self, graph, prefix=False):
            rows = graph.positions.select("seq_id", "pos", F.concat_ws("\t", "seq_id", "pos", F.col("pos") + graph.k).alias("line"))
            return writers.part(rows, 1)

    graph = JunctionGraph(table(spark, genomes(1)), 5)
    assert graph.write("bed", str(tmp_path / "x.bed")) == (tmp_path / "x.bed").stat().st_size
    assert (tmp_path / "x.bed").read_text() == "".join(f"{i}\t{p}\t{p + 5}\n" for i, found in enumerate(model(genomes(1), 5)[1]) for p in found)
    with pytest.raises(ValueError):
        writers.register(type("Nameless", (writers.Format,), {}))


def test_ids_are_bounded(spark):
    rows = spark.createDataFrame([(1, segments.MOST_ID - 1), (2, segments.MOST_ID)], "n int, id long")
    number = segments.segment_number(F.col("id"), F.lit(3).cast("long"), F.lit("A"), F.lit("C"))
    assert rows.where("n = 1").select(number).first()[0] is not None
    with pytest.raises(Exception, match="too large"):
        rows.select(number).collect()


def test_command_line(spark, tmp_path, capsys, caplog):
    from junctura import cli

    genome, binary = tmp_path / "g.fa", tmp_path / "g.bin"
    genome.write_text("".join(f">s{i}\n{s}\n" for i, s in enumerate(genomes(4, gaps=0))))
    with caplog.at_level("INFO", "junctura"):
        cli.main(["build", "-k", "7", "-f", "20", "-o", str(binary), str(genome)])
    assert "junctions among" in caplog.text and f"{binary.stat().st_size} bytes" in caplog.text
    direct = JunctionGraph(fasta.read_fasta(spark, str(genome)), 7)
    for fmt in ("seq", "gfa1", "group"):
        extra = ["-s", str(genome)] if fmt == "gfa1" else []
        cli.main(["dump", "-k", "7", "-f", fmt, *extra, "-o", str(tmp_path / fmt), str(binary)])
        assert (tmp_path / fmt).read_text() == text(direct, fmt)
    capsys.readouterr()
    cli.main(["dump", "-k", "7", "-f", "seq", str(binary)])
    assert capsys.readouterr().out == (tmp_path / "seq").read_text()
    with pytest.raises(SystemExit):
        cli.main(["build", "-k", "4", str(genome)])
    with pytest.raises(SystemExit):
        cli.main(["dump", "-k", "7", "-f", "gfa2", "-o", "x", str(binary)])
    with pytest.raises(SystemExit):
        cli.main(["dump", "-k", "7", "-f", "bam", str(binary)])


def test_functions(spark):
    row = spark.range(1).select(
        dna.reverse_complement(F.lit("AACGN")).alias("rc"), dna.packed(F.lit("ACGT")).alias("p"), dna.unpacked(F.lit(27), 5).alias("u"),
        dna.normalised(F.lit("ACRYN")).alias("n"), dna.ascii_upper(F.lit("acß")).alias("up"), dna.letter_of(F.lit(2)).alias("l"), dna.letter_of(F.lit(9)).alias("m"),
    ).first()
    assert tuple(row) == ("NCGTT", 27, "AACGT", "ACNNN", "ACß", "G", "N")
    with pytest.raises(ValueError):
        windows.check_k(4)


def test_lookup_and_edges(spark):
    seqs = genomes(1)
    graph = JunctionGraph(table(spark, seqs), 5)
    ids = {r.ck: r.id for r in graph.junctions.collect()}
    key = next(iter(ids))
    asked = junctions.kmer_table(spark, [key, rc(key), "NNNNN"])
    assert [r.junction_id for r in sorted(junctions.lookup(asked, graph.junctions).collect(), key=lambda r: [key, rc(key), "NNNNN"].index(r.kmer))] == [ids[key], -ids[key], None]
    edges = {s[i : i + 6] for s in seqs for i in range(len(s) - 5) if "N" not in s[i : i + 6]}
    edges |= {rc(e) for e in edges}
    for r in junctions.edge_degrees(graph.sequences, graph.occurrences, 5).collect():
        assert (r.in_edges, r.out_edges) == (sum(c + r.ck in edges for c in "ACGT"), sum(r.ck + c in edges for c in "ACGT"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_positions_are_not_shuffled(spark):
    """No k-mer is shuffled to find its junction, and positions and what joins them to pieces stay in runs."""
    graph = JunctionGraph(table(spark, genomes(3, gaps=0)), 7)
    assert not any("Exchange" in line for line in plan(graph.positions))
    assert not any("segment" in line for line in plan(graph.pieces) if "Exchange" in line)
    assert not any("code" in line for line in plan(graph._runs(graph.stubs)) if "Exchange" in line)


def test_shuffled_junctions_give_the_same_graph(spark, monkeypatch):
    """More junctions than are sent to all tasks: occurrences are shuffled to them, with the same runs."""
    seqs = [*genomes(6, gaps=0.01), "ACGT", "", genomes(11, n=1, length=40, gaps=0)[0] * 30]
    expected = {fmt: text(JunctionGraph(table(spark, seqs), 5), fmt) for fmt in ("seq", "gfa2")}
    monkeypatch.setattr(junctions, "BROADCAST_ROWS", 0)
    assert {fmt: text(JunctionGraph(table(spark, seqs), 5), fmt) for fmt in expected} == expected


def test_numbers_of_runs_are_those_of_rows(spark):
    graph = JunctionGraph(table(spark, genomes(4, gaps=0.01)), 5)
    after = segments.neighbours.with_next(graph.positions, "pos", F.struct("junction_id", "prev"), "after").where("after is not null")
    q = F.translate("after.prev", "ACGT", "TGCA")
    rows = after.select("seq_id", F.col("pos").alias("begin"), segments.segment_number(F.col("junction_id"), F.col("after.junction_id"), F.col("next"), q).alias("x"))
    joined = rows.join(graph.pieces, ["seq_id", "begin"]).select("x", "segment_id").collect()
    assert len(joined) == graph.pieces.count() and all(r.x == r.segment_id if r.x is not None else r.segment_id >= segments.RESERVED for r in joined)


def test_parts_are_spelled_to_one_row_each(spark):
    graph = JunctionGraph(table(spark, genomes(3, gaps=0)), 5)
    assert segments.respelled(graph.paths, graph.segments, 5).count() == graph.paths.count() < graph.pieces.count()


def test_whole_group_lines_take_one_shuffle(spark):
    graph = JunctionGraph(table(spark, genomes(3)), 5)
    assert sum("Exchange" in line for line in plan(formats.group_lines(graph.positions))) == 1


def test_blocks_of_a_file_are_small():
    """Thousands of blocks reach a task at a time, so their size bounds its memory."""
    batch = pa.RecordBatch.from_pydict({"_part": [3], "data": [bytes(range(256)) * 80_000]})
    rows = [r for b in positional._encoded(lambda b: b.column("data")[0].as_py())(iter([batch, batch])) for r in b.to_pylist()]
    assert max(len(r["data"]) for r in rows) <= positional.BLOCK <= 1 << 14
    assert b"".join(r["data"] for r in rows) == bytes(range(256)) * 160_000
    assert all(a["at"] + len(a["data"]) == b["at"] for a, b in zip(rows, rows[1:], strict=False))


def test_edges_and_strands_by_numbers(spark):
    graph = JunctionGraph(table(spark, [*genomes(2), "ACGTT", "AACGTT"]), 5)
    by_letters = junctions.both_strands(graph.occurrences)
    by_numbers = packed.named(packed.both_strands(graph.sequences, 5).where(junctions.is_junction()), 5).select(F.col("ck").alias("kmer"), "in_degree", "out_degree")
    assert sorted(map(tuple, by_numbers.collect())) == sorted(map(tuple, by_letters.collect()))
    found = junctions.edge_degrees(graph.sequences, graph.occurrences, 5)
    assert not any("canonical" in line for line in plan(found) if "Exchange" in line) and found.count() == graph.vertices.count()


def test_names_are_not_joined_to_runs(spark):
    """Runs bring the names and lengths of their sequences along, in pieces of sequences, too; where they can't, names are joined to them."""
    known = JunctionGraph(table(spark, genomes(8, gaps=0)), 7).labelled()  # without unknown letters: reserved ids are joined
    assert "Join" not in known._jdf.queryExecution().optimizedPlan().toString()
    seqs = genomes(9, length=3000)
    graph = JunctionGraph(table(spark, seqs), 7)
    pieces = spark.createDataFrame([(i, f"h{i}", at, s[at : at + 700], len(s)) for i, s in enumerate(seqs) for at in range(0, len(s), 700)], "seq_id long, header string, start long, seq string, length long")
    bare = JunctionGraph(table(spark, seqs), 7)
    bare.runs = graph.runs.drop("header", "length")
    rows = [sorted(tuple(r) for r in formats.occurrence_lines(g.labelled(True), 7, 2).collect()) for g in (graph, JunctionGraph(pieces, 7), bare)]
    assert rows[0] == rows[1] == rows[2] and rows[0]


def test_partitions_of_kmers_follow_the_letters(spark, monkeypatch):
    """Where the session has too few partitions, what one holds does not grow with the input."""
    seqs = genomes(10, length=2000)
    few = sorted(map(tuple, packed.degrees(table(spark, seqs), 25).collect()))
    monkeypatch.setattr(packed, "HELD", 500)
    found = packed.degrees(table(spark, seqs), 25)
    assert found.rdd.getNumPartitions() == -(-sum(map(len, seqs)) // 500) > 4
    assert sorted(map(tuple, found.collect())) == few


def test_links_and_segments_meet_by_few_shuffles(spark):
    """Equal links meet where the first segment's end is, and go to the second segment once: of what overlaps() is given, four tables are shuffled."""
    graph = JunctionGraph(table(spark, [*genomes(12, gaps=0.01), "ACGTACGTACGTA" * 9]), 5)
    links, bodies = ranking.written(graph.links, "links"), ranking.written(graph.segments, "segments")
    wrong = bodies.withColumn("body", F.when(F.col("segment_id") == bodies.agg(F.min("segment_id")).first()[0], F.reverse("body")).otherwise(F.col("body")))
    rows, known = links.select("a", "b").collect(), {abs(r.segment_id): r.body for r in wrong.collect()}
    spelled = lambda x: known[abs(x)] if x > 0 else rc(known[abs(x)])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = segments.overlaps(links, wrong, 5)
        assert sum("Exchange hashpartitioning" in line for line in plan(found)) == 4
        assert tuple(found.first()) == (len(rows), sum(spelled(r.a)[-5:] != spelled(r.b)[:5] for r in rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("merged", [1, 7, 1 << 21])
def test_equal_links_of_a_task_are_counted(spark, monkeypatch, merged):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-3, 4, 500), rng.integers(-3, 4, 500)
    monkeypatch.setattr(packed, "MERGED", merged)
    batches = [pa.RecordBatch.from_pydict({"a": a[i : i + 50], "b": b[i : i + 50]}) for i in range(0, 500, 50)]
    rows = [r for x in packed._counted(iter([*batches, batches[0].slice(0, 0)])) for r in x.to_pylist()]
    got = Counter()
    for r in rows:
        got[r["a"], r["b"]] += r["n"]
    assert got == Counter(zip(a.tolist(), b.tolist(), strict=True)) and (merged < 1 << 21 or len(rows) == len(got))
    assert not list(packed._counted(iter([])))


@pytest.mark.parametrize("query", ["q14_gfa1_paths", "q18_gfa2_paths"])
def test_whole_path_lines_take_one_shuffle(spark, query):
    """Paths are shuffled once, by sequence, and not by parts first; besides them only borders of ranges are."""
    lines = [line for line in plan(catalog.QUERIES[query](spark, "/root/testdata/sf0.001")) if "Exchange hashpartitioning" in line and "_span" not in line]
    assert len(lines) == 2 and sum("REPARTITION_BY_COL" in line for line in lines) == 1


@pytest.mark.parametrize("variant", sequences.VARIANTS)
def test_letters_of_documents(spark, variant):
    """Letters are taken by bytes, and no text by a regular expression; other characters, of any number of bytes, go."""
    texts = [None, "", "zz", "aCgT", "Ünächst ACGT\u212akK\u0131\n", "\U0001f600xy\x00nN", "acgtURYKMSWBDHVXN-" * 300, "", "é"]
    kept, unknown = sequences.VARIANTS[variant]
    expected = [(i, f"doc{i}", s := "".join("N" if c.upper() in unknown else c.upper() for c in t or "" if c in kept + kept.lower()), len(s)) for i, t in enumerate(texts)]
    found = sequences.from_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), variant)
    assert sorted(tuple(r) for r in found.select("seq_id", "header", "seq", "length").collect()) == expected
    assert not any("regexp" in line for line in plan(found))


def lines_of(places):
    """What group_lines() gives of rows (junction_id, seq_id, pos), by a plain loop."""
    found = {}
    for number, seq, pos in sorted(places):
        found.setdefault(number, []).append((seq, pos))
    return sorted((*x[0], "".join(f"{s} {p}; " for s, p in x)) for x in found.values())


@pytest.mark.parametrize("size", [1, 2, 7, 500])
def test_group_lines_go_on_from_batch_to_batch(size):
    rng = np.random.default_rng(size)
    places = sorted(set(zip((rng.integers(-3, 4, 300) ** 3).tolist(), rng.integers(-5, 1 << 40, 300).tolist(), rng.integers(0, 99, 300).tolist(), strict=True)))
    table = pa.Table.from_pylist([dict(zip(("junction_id", "seq_id", "pos"), x, strict=True)) for x in places])
    batches = table.to_batches(max_chunksize=size)
    got = [tuple(r.values()) for b in formats._whole_lines(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()]
    assert sorted(got) == lines_of(places)
    assert not list(formats._whole_lines(iter([batches[0].slice(0, 0)])))


def test_a_group_line_is_held_as_its_text_alone():
    """A line of a million places takes about its own bytes, not those of its places."""
    batches = (pa.RecordBatch.from_pydict({"junction_id": np.full(10_000, -1), "seq_id": np.full(10_000, 1_000_000 + i), "pos": np.arange(10_000)}) for i in range(100))
    tracemalloc.start()
    try:
        (found,) = formats._whole_lines(batches)
        size, peak = len(found.column("line")[0].as_py()), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert size == 100 * sum(len(f"1000000 {i}; ") for i in range(10_000)) and peak < 4 * size


def test_group_lines_collect_no_places(spark, monkeypatch):
    """No array holds an id's places, in the query or of any table of positions; partitions follow the positions where the session has too few."""
    found = catalog.QUERIES["q08_group_lines"](spark, "/root/testdata/sf0.001")
    graph = JunctionGraph(table(spark, genomes(13)), 5)
    monkeypatch.setattr(packed, "HELD", 100)
    dealt = packed.dealt(graph.runs)
    assert not any("collect" in line or "Aggregate" in line for df in (found, formats.group_lines(graph.positions)) for line in plan(df))
    places = [tuple(r) for r in graph.positions.select("junction_id", "seq_id", "pos").collect()]
    assert dealt.rdd.getNumPartitions() == -(-len(places) // 100) > 4
    assert sorted(map(tuple, dealt.collect())) == sorted(places)
    assert sorted(map(tuple, formats.group_lines(dealt, dealt=True).collect())) == lines_of(places)


def test_group_lines_of_far_numbers(spark):
    """Order does not depend on numbers fitting 32 bits."""
    ids, seqs = [1, -1, 7, (1 << 31) - 1, 1 << 31, 1 << 40, -(1 << 31), -(1 << 40)], [-(1 << 40), -1, 0, 5, (1 << 32) - 1, 1 << 32, 1 << 50]
    places = [(i, s, p) for p in (11, 2, 30) for s in seqs for i in ids]
    df = spark.createDataFrame(places, "junction_id long, seq_id long, pos long")
    assert sorted(map(tuple, formats.group_lines(df).collect())) == lines_of(places)


@pytest.mark.parametrize("dealt", [1, 3, 1 << 10])
def test_positions_of_runs_are_dealt(monkeypatch, dealt):
    """Each part of some runs is one row; runs without positions and sequences without an id go through."""
    monkeypatch.setattr(packed, "DEALT", dealt)
    runs = [{"seq_id": 4, "start": 512, "at": [0, 3], "id": [5, -5]}, {"seq_id": None, "start": 0, "at": [1], "id": [-1]}, {"seq_id": 2, "start": 0, "at": [], "id": []}, {"seq_id": 9, "start": 0, "at": [8, 9, 11], "id": [1, 5, 1]}]
    schema = pa.schema([("seq_id", pa.int64()), ("start", pa.int64()), ("at", pa.list_(pa.int32())), ("id", pa.list_(pa.int64()))])
    parts = [x for b in packed._dealt(3)(iter([pa.RecordBatch.from_pylist(runs, schema=schema)])) for x in b.to_pylist()]
    rows = [(x["part"], *r.values()) for x in parts for b in packed._unpacked(iter([pa.RecordBatch.from_pylist([x])])) for r in b.to_pylist()]
    assert sorted(rows, key=str) == sorted([(i % 3, i, r["seq_id"], r["start"] + at) for r in runs for i, at in zip(r["id"], r["at"], strict=True)], key=str)
