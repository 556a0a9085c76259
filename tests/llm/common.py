"""Small documents with the cases that every operator has to bear, and a plain word splitter."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
VOCABULARY = "alpha beta gamma delta über straße 漢字 niño été zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def rows():
    """(doc_id, text): null, empty, spaces, short, long, copies, near copies, shared passages, repeated rows."""
    base = [prose(k, 30 + 17 * k) for k in range(8)]
    passage = prose("shared", 60)
    out = [None, "", " \n\t ", "one", "one two", "One TWO three", base[0], base[0] + " ", base[0].upper(), base[1], base[1], base[1] + " more"]
    out += [f"{base[2]} {passage} {base[3]}", f"{base[4]}\n{passage}\n{base[5]}", passage, "a b c " * 40, prose("long", 6000), "  x y  \x1f z\x85"]
    out += [prose("long", 6000) + " end", "12345 !!! <|endoftext|> it's we'll\r\n\r\n  x"]
    return [*enumerate(out), (9, base[1]), (None, base[6]), (None, None)]


def frame(spark, data=None, extra=True):
    """As ``documents``, with columns whose names may clash with an operator's own."""
    data = rows() if data is None else data
    schema = "doc_id long, text string" + (", lang string, id long, fp long, kept boolean, n int, a string, h long, nth long, pos int" if extra else "")
    pad = (None,) * 9 if extra else ()
    return spark.createDataFrame([(*r, *pad) for r in data], schema)
