import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: Extra columns, some of them with names that the operators use themselves.
KINDS = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, bytes string, words long, shard string"

CLEAN = "\n".join(" ".join(f"the {a}{b}{c} of {b}{c}{a}" for b in ("ba", "ne", "di", "ro")) for a in ("ka", "lo", "mi") for c in ("tu", "se"))


def texts(seed=3):
    """Short texts with shared passages, copies, repeated words and lines, odd spaces, and junk."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "la", "de", "der", "und", "los", *("".join(rng.choice("abcdeéñüß") for _ in range(rng.randint(2, 7))) for _ in range(300))]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, other = prose(60), prose(130)
    out = [prose(rng.randint(1, 120)) for _ in range(12)]
    out += [prose(20) + "\n" + passage + " " + prose(30), passage, "\t" + passage.replace(" ", "\n ") + " ", prose(5) + " " + other + " " + passage, other[:400] + " x " + other[400:]]
    out += [out[3], out[3], out[3].upper(), out[5] + " end", other + " " + other, "a " * 120, "word word word " * 40]
    out += ["", None, " \t\n", "one", "two words", "\x0b\x0cthree short words\r", "x" * 5000, "né " * 60, " not a space here " + prose(60)]
    out += ["\n".join(["same line of text here"] * 5 + [prose(60)]), " ".join(w + "&&&" for w in prose(80).split()), prose(49), prose(50), prose(51)]
    out += [prose(6000), "<|endoftext|> Ünïcode, it's A'll 42 ½ É. e\u0301. I\u0307, İ! Σ. ?! a.b, (x). " + prose(10), "<|ENDOFTEXT|> <|startoftext|>, x<|endoftext|>. \x02 a\x02"]
    out.append(CLEAN)
    return out


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "r", "b", 2, "s") for i, t, s in rows], KINDS)


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source): a hot source, a null source, a null doc_id, repeated rows and a repeated doc_id."""
    found = [(i, t, ["a", "b", "a", None, "a", "c"][i % 6]) for i, t in enumerate(texts())]
    return [*found, found[0], found[12], (7, "another text of document seven " * 12, "b"), (None, found[12][1], "a"), (None, None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return documents(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, [])
