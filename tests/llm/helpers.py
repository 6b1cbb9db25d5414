"""A small corpus with every awkward row, and brute-force answers."""

import random

CLASHING = ["key", "chunk", "blob", "bucket", "fp", "line", "site", "n_lines", "held_out", "score", "predicted", "_doc", "_gone", "words", "payload", "ids", "start", "length", "vec", "least", "component_id", "grp", "count"]


def corpus(seed=3, n=60):
    """(doc_id, text, lang, source): nulls, empties, repeats, copies, near copies, shared passages,
    one long text, other scripts, odd white space."""
    g = random.Random(seed)
    vocabulary = ["".join(g.choice("abcdeéñü") for _ in range(g.randint(1, 7))) for _ in range(150)]

    def text(words):
        return " ".join(g.choice(vocabulary).title() if g.random() < 0.1 else g.choice(vocabulary) for _ in range(words))

    shared = [text(15) for _ in range(3)]
    rows = []
    for k in range(n):
        lines = [text(g.randint(1, 25)) for _ in range(g.randint(1, 5))]
        if k % 4 == 0:
            lines.insert(g.randint(0, len(lines)), shared[k % 3])
        if k % 5 == 0:
            lines.append("Accept all cookies.")
        rows.append((k, "\n".join(lines), "en", f"src{k % 13}"))
    rows += [(100 + k, rows[7][1], "en", f"src{k}") for k in range(6)]  # copies
    rows += [(110 + k, rows[9][1] + f" {vocabulary[k]}", "en", None) for k in range(4)]  # near copies
    rows += [(120, "", "en", "src1"), (121, None, None, None), (122, "   \n\t ", "en", "src2"), (123, "x", "en", ""), (124, "a\n\nb\n", "en", "src3")]
    rows += [(5, rows[5][1], "en", "src5"), (5, "another text under the same id", "en", "src6")]  # repeats
    rows += [(None, "a text without an id " + shared[0], "en", "src7"), (None, None, None, None)]
    rows += [(130, text(4000), "de", "src8"), (131, "日本語 テキスト 🙂 " * 30, "ja", "src9"), (132, "na\x00ul \x1c odd space  two   three", "en", "src1")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows=None):
    """The corpus as a table with a column n_chars and extra columns of clashing names."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return frame.repartition(3).withColumns({c: F.lit("clash") for c in CLASHING})


def components(n, links):
    label = list(range(n))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]
