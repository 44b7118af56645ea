"""Small tables in the given tables' form: ordinary, odd and empty."""

import datetime as dt  # noqa: F401

import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven bright children count small grey stones near one old river bank and sing".split()
LANGS, SOURCES = ("en", "fr", None), ("src0", "src1", None)


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 2654435761 % 4294967296
    for i in range(n):
        x = (x * 1664525 + 1013904223) % 4294967296
        out.append(WORDS[x >> 27 if (x >> 27) < len(WORDS) else x % len(WORDS)] + str(x >> 20 if i % 7 == 0 else "").translate(str.maketrans("0123456789", "abcdefghij")) + (".\n" if i % 11 == 10 else ""))
    return " ".join(out).replace("\n ", "\n")


def odd_rows() -> list[tuple]:
    shared = "\n".join(prose(900 + i, 12).replace("\n", " ") for i in range(6))
    rows = [(i, prose(i, 60 + 7 * i), LANGS[i % 3], SOURCES[i % 3], 1) for i in range(24)]
    rows += [(30, None, "en", "src0", None), (31, "", "en", "src0", 0), (32, " \t\n ", None, None, 4), (33, "word", "en", "src1", 4), (34, "a b c d", "en", "src1", 7)]
    rows += [(40 + i, f"{prose(50 + i, 30)}\n{shared}\n{prose(70 + i, 30)}", "en", "src0", 5) for i in range(6)]                         # a shared passage
    rows += [(50, prose(3, 81), "fr", "src0", 5), (51, prose(3, 81) + " end", "fr", "src0", 5), (52, prose(3, 81), "en", "src1", 5)]    # copies
    rows += [(60, prose(60, 50), "en", "src0", 5)] * 2 + [(None, prose(61, 50), "en", "src0", 5), (None, prose(62, 40), "en", "src0", 5), (None, prose(62, 40), "en", "src0", 5)]
    rows += [(70, prose(70, 6000), "en", "src0", 5), (71, "x" * 50_000, "en", "src0", 5), (72, "same line\n" * 3000, "en", "src0", 5)]  # very long
    rows += [(80, "Mail jo.x@mail.example.com or +1 (651) 555-8500; card 4111111111111111, host 10.0.0.1. " + prose(8, 60), "en", "src0", 5),
             (81, "é日本 🙂 a.b@c.de +49 30 1234567 and " + "1" * 4000 + " 999.1.1.1 1.2.3.4", "en", "src0", 5), (82, "### %%% " * 40 + prose(9, 60), "en", "src0", 5),
             (83, "<|endoftext|> It's we'll ́x ﬁ ſ end  two  spaces ", "en", "src0", 5),
             (84, "MIT-License mit\nLicense, mit license. " + "Apache License " * 300 + "general\tPUBLIC license", "en", "src0", 5), (85, "Licensed under CC BY-NC 4.0.\n" + prose(85, 40), "en", "src0", 5)]
    return rows


DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = {"doc": "7", "out": "'x'", "row": "1.5", "fp": "null", "place": "2", "words": "array(1)", "n_words": "3", "id": "4", "value": "'v'", "kept": "false", "hashes": "5"}


def odd_embeddings() -> list[tuple]:
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 37 + j * 101 + i * j * 13) % 97) / 48.5 - 1 for j in range(20)]) for i in range(60)]
    rows += [(i + 100, rows[i][1]) for i in range(30)] + [(0, rows[7][1]), (None, rows[8][1]), (None, rows[59][1])]                      # repeats of vectors, ids and rows
    return rows + [(200, None), (201, []), (202, [nan] * 20), (203, [1.0, None] * 10), (204, [inf] + [0.0] * 19), (205, [0.5] * 3), (206, [0.25] * 3), (207, [100.0] + [0.0] * 19)]


def odd_conversations() -> list[tuple]:
    roles = ("user", "assistant", "user", "assistant", "system", "tool", None, "")
    texts = ("Yes.", "No", None, "", " \t\n", "Why not? ", "Same here!", "é日本🙂.", "wait...  ", "x" * 20_000)
    x, rows = 12345, []
    for c in range(80):
        for t in range(c % 9):
            x = (x * 1664525 + 1013904223) % 4294967296
            usual = (t % 2, 7 * c + t)
            rows.append((c, None if x % 31 == 0 else t + x % 3 // 2, roles[usual[0] if x % 5 else x % 8], f"Turn {usual[1]}." if x % 3 else texts[(x >> 9) % 10]))
    rows += [(1000, t, roles[t % 2 if t % 13 else 4], f"Row {t}." if t % 17 else "Again.") for t in range(150)]                          # a long one
    return rows + [(7, 0, "user", "Yes.")] * 3 + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (-5, -3, None, None), (-5, None, None, None)]


def write(spark, folder, docs, pages, labels, embeddings=(), conversations=()):
    from pyspark.sql import functions as F
    d = spark.createDataFrame(docs, DOC)
    # an extra column after the given ones, with names that operators might use themselves
    d.select("*", *[F.expr(v).cast("string").alias(k) for k, v in EXTRA.items()]).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(2).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    more = [F.expr(v).cast("string").alias(k) for k, v in {"x": "1", "n": "2", "component": "3", "part": "4", "seq": "'y'", "gone": "false", "place": "null", "c": "5", "s": "6"}.items()]
    spark.createDataFrame(list(embeddings), "vec_id bigint, embedding array<float>, label int").select("*", *more).coalesce(2).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(list(conversations), "conv_id bigint, turn bigint, role string, text string").select("*", *more).coalesce(2).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    page = "<html>" + "p" * 1500
    pages = [(0, "http://www.A.example.com/x?y=1#z", "<p>é</p>"), (1, None, None), (2, "https://b.example.org", page), (3, "https://b.example.org", page), (4, "b", page + "\r\n\r\nWARC/1.1\r\n\r\n"), (5, "u\r\nv", ""),
             (None, "http://c.example.net/", page), (6, "http://c.example.net/", "q" * 999), (7, "http://c.example.net/", "q" * 999), (8, "http://c.example.net/" + "long/" * 2000, "w" * 200_000)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(24)] + [(None, 1, 1), (30, 1, None), (31, None, 0), (999, 1, 1)]
    return write(spark, tmp_path_factory.mktemp("odd"), odd_rows(), pages, labels, [(*r, 1) for r in odd_embeddings()], odd_conversations())


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [])
