"""Names in texts: how often a large vocabulary of names and aliases is mentioned.

All names are searched in one pass over each text by a multi-pattern automaton, built once per Python worker. The names travel with the
task, so their size is measured first: a vocabulary beyond `limit` bytes is dealt into parts by a hash of the entity, and the texts are read once
per part, one part after the other, so that the driver never holds more than one. No text is shuffled; what leaves the tasks is one row per text and entity found in it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import Rounds, cut_lineage

#: Bytes of names that one automaton may hold; it takes some forty times as much memory in a worker.
LIMIT = 8_000_000
#: Mentions that a worker gathers before it hands them on.
ROWS = 20_000
_IDEOGRAM = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}])"


def folded(text: Column) -> Column:
    """Tokens of letters and digits in lower case, one space before, between and after them; an ideogram is a token of its own. No token: one space."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _IDEOGRAM, " $1 ")
    return F.regexp_replace(F.concat(F.lit(" "), spaced, F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


_BUILT: dict[bytes, object] = {}


def _automaton(data: bytes):
    """The automaton of a part of the names, kept for the tasks that follow in this worker."""
    if data not in _BUILT:
        import ahocorasick
        _BUILT.clear()      # first, so that a worker never holds two
        a = ahocorasick.Automaton()
        for b in pa.ipc.open_stream(data):
            for who, name in zip(b["entity_id"].to_pylist(), b["name"].to_pylist()):
                owners = a.get(name, None)
                if owners is None:
                    a.add_word(name, [who])
                else:
                    owners.append(who)
        a.make_automaton()
        _BUILT[data] = a
    return _BUILT[data]


def _part(names: DataFrame, i: int, n: int) -> bytes:
    """One of n parts of the names as an Arrow stream; all names of an entity are in the same one."""
    t = names.filter(F.pmod(F.xxhash64("entity_id"), F.lit(n)) == i).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def find_names(docs: DataFrame, text: str, names: DataFrame, keep: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """(keep, entity_id, n_hits): per text the entities it mentions and how often, whole tokens only. names: entity_id, name, any number per entity.

    Overlapping mentions all count; a name given twice for an entity counts once. Null texts and names without a letter or digit mention nothing.
    """
    return _find(docs, text, _vocabulary(names), keep, limit)


def _vocabulary(names: DataFrame) -> DataFrame:
    """(entity_id, name): the names as they are looked for, each once per entity."""
    return names.select("entity_id", folded(F.col("name")).alias("name")).filter("name <> ' ' AND entity_id IS NOT NULL").distinct()


def _find(docs: DataFrame, text: str, vocabulary: DataFrame, keep: Sequence[str], limit: int) -> DataFrame:
    kept = F.struct(*[F.col(c) for c in keep]).alias("doc")
    src = docs.select(kept, folded(F.col(text)).alias("text")).filter("text <> ' '")
    schema = T.StructType([src.schema["doc"], T.StructField("entity_id", vocabulary.schema["entity_id"].dataType), T.StructField("n_hits", T.LongType())])

    def search(data: bytes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type
            automaton = _automaton(data)
            kind = to_arrow_type(schema["entity_id"].dataType)
            for b in batches:
                at, who, n = [], [], []
                for i, t in enumerate(b.column(1) if len(automaton) else ()):
                    found: dict = {}
                    for _, owners in automaton.iter(t.as_py()):
                        for x in owners:
                            found[x] = found.get(x, 0) + 1
                    at += [i] * len(found)
                    who += found.keys()
                    n += found.values()
                    if len(at) >= ROWS or i == b.num_rows - 1:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(who, kind), pa.array(n, pa.int64())], names=schema.names)
                        at, who, n = [], [], []
        return run

    n = max(1, -(-(vocabulary.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0) // limit))
    if n == 1:
        found = src.mapInArrow(search(_part(vocabulary, 0, 1)), schema)
    else:
        vocabulary, rounds = cut_lineage(vocabulary), Rounds(docs.sparkSession)
        for i in range(n):
            rounds.add(src.mapInArrow(search(_part(vocabulary, i, n)), schema))
        found = rounds.all()
    return found.select("doc.*", "entity_id", "n_hits")


def mention_counts(docs: DataFrame, names: DataFrame, day: str = "obs_date", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(entity_id, day, n_docs, n_hits): documents of the day that mention an entity, and mentions in them.

    The texts are searched for names, not for entities: what leaves the tasks is bounded by the texts, however many entities share a name, and is counted per name before
    entities meet it. Only where an entity has names of which none holds the other, the documents with any of them are counted in a second pass, once for all entities named alike.
    """
    owned = cut_lineage(_vocabulary(names).groupBy("entity_id").agg(F.sort_array(F.collect_set("name")).alias("names")))
    # a document with a name has every name inside it, so those that hold no other one tell the documents
    least = F.filter("names", lambda a: ~F.exists("names", lambda b: (a != b) & F.contains(a, b)))
    owned = owned.withColumn("least", least)
    each = owned.select(F.explode("names").alias("name")).distinct().select(F.col("name").alias("entity_id"), "name")
    by_name = _find(docs, text, each, [day], limit).groupBy(F.col("entity_id").alias("name"), day).agg(F.count(F.lit(1)).alias("n"), F.sum("n_hits").alias("hits"))
    of = owned.select("entity_id", F.explode("names").alias("name"), F.when(F.size("least") == 1, F.col("least")[0]).alias("one"), F.when(F.size("least") > 1, F.array_join("names", "\n")).alias("set"))
    n_docs = F.sum(F.when(F.col("name") == F.col("one"), F.col("n"))).alias("n_docs")
    counts = of.join(by_name, "name").groupBy("entity_id", "set", day).agg(n_docs, F.sum("hits").alias("n_hits"))
    several = owned.filter(F.size("least") > 1).select("names").distinct()
    if not several.isEmpty():
        sets = several.select(F.array_join("names", "\n").alias("entity_id"), F.explode("names").alias("name"))
        by_set = _find(docs, text, sets, [day], limit).groupBy(F.col("entity_id").alias("set"), F.col(day).alias("_day")).agg(F.count(F.lit(1)).alias("n_any"))
        same = (counts["set"] == by_set["set"]) & counts[day].eqNullSafe(by_set["_day"])
        counts = counts.join(by_set, same, "left").select("entity_id", day, F.coalesce("n_docs", "n_any").alias("n_docs"), "n_hits")
    return counts.select("entity_id", day, "n_docs", "n_hits")


def brand_in(df: DataFrame, text: str, vocabulary: DataFrame, key: Sequence[str], mode: str = "first", limit: int = LIMIT) -> DataFrame:
    """(key, brand) of the texts that name a brand, for a vocabulary too large for literals. vocabulary: entity_id (its order), name.

    `first` takes the earliest brand of the vocabulary, `longest` the longest one found (the earlier one of equals). `key` tells the rows of `df` apart.
    """
    ranked = vocabulary.groupBy("entity_id").agg(F.min("name").alias("name"))
    found = find_names(df, text, ranked, key, limit).join(ranked, "entity_id")
    order = F.col("entity_id") if mode == "first" else F.struct(-F.length("name"), F.col("entity_id"))
    return found.groupBy(*key).agg(F.min_by("name", order).alias("brand"))
