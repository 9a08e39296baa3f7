"""Classes of lines from stars against those from all links, and the verification of very long lines."""

import random
import time

from pyspark.sql import functions as F

from seqloom.llm import lines


def classes(spark, texts, all_links):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = lines.line_report(docs, 2, 8, all_links=all_links).collect()
    return {(r.doc_id, r.line_no): (r.class_doc, r.class_line, r.kept) for r in rows}


def changed(rng, base, n, alphabet):
    x = list(base)
    for _ in range(n):
        i = rng.randrange(len(x))
        x[i : i + rng.randint(0, 1)] = rng.choice([alphabet, ""])[:1] and [rng.choice(alphabet)]
    return "".join(x)


def test_stars_give_the_classes_of_all_links(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = "".join(rng.choice("abcd ") for _ in range(rng.randint(14, 30))).strip().ljust(10, "x")
        far = base
        for _ in range(8):
            far = changed(rng, far, 2, "abxy")  # chains: only neighbours are near
            texts += [far, changed(rng, base, rng.randint(0, 3), "abxy")]
    for k in range(4):
        words = [f"word{rng.randrange(50)}" for _ in range(40 + 30 * k)]
        for _ in range(6):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    assert classes(spark, texts, False) == classes(spark, texts, True)


def test_rows_made_grow_with_a_group_of_near_copies(spark):
    """One line and many copies with two changed characters each: links stay in proportion."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghijklmnop") for _ in range(90))
    made = {}
    for n in (100, 400):
        copies = {base}
        while len(copies) < n:
            x = list(base)
            for i in rng.sample(range(len(x)), 2):
                x[i] = rng.choice("0123456789")
            copies.add("".join(x))
        docs = spark.createDataFrame(list(enumerate(sorted(copies))), "doc_id long, text string")
        found, links = lines.line_classes(docs, all_links=False)
        assert found.select("class_first").distinct().count() == 1
        made[n] = links.count()
    assert made[400] < 8 * made[100] and made[400] < 8 * 400


def test_verification_is_linear():
    body = "".join(random.Random(1).choice("abcdefgh ") for _ in range(400_000))
    begun = time.process_time()
    assert lines.within("x" + body + "y", "z" + body + "w", 2)
    assert not lines.within("x" + body + "yy", "z" + body + "ww", 2)
    assert time.process_time() - begun < 20


def test_clashing_columns_keep_their_values(spark):
    line = "a line that stands in two documents, word for word or nearly so"
    rows = [(1, line, 10, "a", "b", "c", "d"), (2, f"{line}\nother words", 20, "e", "f", "g", "h"), (3, None, 30, "i", "j", "k", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, _text string, new string, gone string, own_id string")
    got = {r.doc_id: tuple(r) for r in lines.without_repeated_lines(docs).collect()}
    assert got == {1: rows[0], 2: (2, "other words", *rows[1][2:]), 3: rows[2]}
    assert lines.without_repeated_lines(docs).columns == docs.columns
    assert lines.without_repeated_lines(docs.filter(F.lit(False))).count() == 0
