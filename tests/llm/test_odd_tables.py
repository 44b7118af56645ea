"""Every query on odd and on empty tables: nulls, empty and very long texts, repeated rows and ids, extra columns with names the operators use."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import DOC, odd_rows
from tidemark.llm import idcoder, linededup, packing, pii, simhash
from tidemark.llm.common import QUERIES, SQL
import tidemark.llm.queries  # noqa: F401

PER_DOC = [q for q in QUERIES if not q.startswith(("op4", "op10", "op11", "op12"))]
DOCS = odd_rows()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_empty_pipeline(spark, empty):
    import corpus_pipeline
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(PER_DOC))
def test_one_row_per_document(spark, odd, name):
    ids = Counter(r[0] for r in QUERIES[name](spark, odd).select("doc_id").collect())
    assert ids == Counter(r[0] for r in DOCS)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("name", ["op4_warc_index", "op7_quality_rules", "op13_license_index"])
def test_sql_twin(spark, odd, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd}/{t}.parquet/*.parquet')")
    want = con.execute(SQL[name]).to_arrow_table()
    got = QUERIES[name](spark, odd)
    cols = [c for c in want.column_names if c not in ("place", "url_key")]
    assert rows(got, *cols) == sorted(zip(*(want[c].to_pylist() for c in cols)), key=repr)


def test_order_of_captures(spark, odd):
    got = sorted((r.place, r.url_key, r.page_id) for r in QUERIES["op4_warc_index"](spark, odd).collect())
    assert [g[0] for g in got] == list(range(10))
    assert [g[1] for g in got] == sorted(g[1] for g in got)


def test_fingerprints(spark, odd):
    got = QUERIES["op8_document_fingerprints"](spark, odd).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by_id[50][0].fingerprint == by_id[52][0].fingerprint == by_id[3][0].fingerprint
    assert by_id[30][0].fingerprint == by_id[31][0].fingerprint == by_id[32][0].fingerprint == ""
    assert by_id[51][0].near_next > 0.8        # 50, its near copy, comes next in falling order
    texts = [t or "" for _, t in sorted(((d, t or "") for d, t, *_ in DOCS if d is not None), reverse=True)]
    ids = sorted((d for d, *_ in DOCS if d is not None), reverse=True)
    import hashlib
    for i in range(len(ids) - 1):
        t, n = texts[i], len(texts[i]) // 3
        assert hashlib.sha256((t[:len(t) - n] + texts[i + 1][:n]).encode()).hexdigest() in {r.edited_sha256 for r in by_id[ids[i]]}


def test_ids_come_back(spark, odd):
    from tokenizers import Tokenizer
    import public_tokenizers
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((d, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for d, x in ((d, tk.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in DOCS))
    got = sorted(QUERIES["op2_id_range_coder"](spark, odd).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and all(r.doc_id is None for r in got[len(ids):])


def test_pieces_are_packed(spark, odd):
    from tokenizers import Tokenizer
    import public_tokenizers
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = QUERIES["op10_best_fit_packing"](spark, odd).collect()
    want = Counter()
    for d, t, *_ in DOCS:
        x = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = packing.cut_points(len(x), 1024)
        want.update((d, i, a, b - a, zlib.crc32(x[a:b].tobytes())) for i, (a, b) in enumerate(zip(at, [*at[1:], len(x)])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1].tolist()] and sum(n for _, n in b) <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 2


def test_base_spans(spark, odd):
    got = defaultdict(list)
    for r in QUERIES["op3_semi_markov_pii"](spark, odd).collect():
        got[r.doc_id].append(r)
    r = got[80][0]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert (got[81][0].n_email, got[81][0].n_ip, got[81][0].n_card, got[81][0].n_phone) == (1, 1, 0, 1)
    assert {x.spans for k in (30, 31, 32) for x in got[k]} == {""}
    import hashlib
    for d, t, *_ in DOCS:
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(t or ""))
        mine = [x for x in got[d] if x.base_sha256 == hashlib.sha256(base.encode()).hexdigest()]
        assert mine and set(filter(None, base.split(","))) <= set(mine[0].spans.split(","))


def test_line_blocks(spark, odd):
    got = {(r.doc_id, r.kept_sha256): r for r in QUERIES["op5_line_alignment"](spark, odd).collect()}
    by_id = {k[0]: r for k, r in got.items()}
    assert by_id[40].n_deleted == 0 and all(by_id[40 + i].n_deleted >= 6 for i in range(1, 6))
    assert by_id[50].kept_chars == by_id[52].kept_chars == 0 and by_id[3].n_deleted == 0
    assert by_id[72].n_deleted == 0 and by_id[30].n_lines == 0 and by_id[31].n_lines == 1


def test_near_copies(spark, odd):
    got = QUERIES["op9_simhash_anchors"](spark, odd).collect()
    fp = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got]
    assert Counter((d, f) for d, f, _ in fp) == Counter((d, simhash.simhash((t or "").encode())) for d, t, *_ in DOCS)
    par = list(range(len(fp)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for i in range(len(fp)):
        for j in range(i):
            if (fp[i][1] ^ fp[j][1]).bit_count() <= 3:
                par[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(fp):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    assert [c for _, _, c in fp] == [least.get(find(i)) for i in range(len(fp))]


def test_severity_is_ordered(spark, odd):
    for r in QUERIES["op1_toxicity_severity"](spark, odd).collect():
        assert 0 <= r.severity <= 2 and r.grade in (0, 1, 2)


def test_pipeline_keeps_columns(spark, odd):
    import corpus_pipeline
    from tidemark.llm.common import cut
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, odd))
        assert out.schema == docs.schema, name
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4] > 0
    left = {r.text for r in docs.collect()}
    assert not any(re.search(r"jo\.x@mail|555-8500", t or "") for t in left)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, odd)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([r for r in DOCS if r[0] in (3, 50, 51, 52, 60) or r[0] is None], DOC)
    left = [r.doc_id for r in simhash.drop_near_copies(docs).collect()]
    assert sorted(left, key=lambda x: (x is None, x or 0)) == [3, 60, None, None]


def test_linededup_keeps_unrelated(spark):
    docs = spark.createDataFrame([(i, f"only {i} has this line of words here\nyes", "en", "s", 3) for i in range(5)], DOC)
    assert {r.n_deleted for r in linededup.align_lines(docs).collect()} == {0}


def test_damage_is_found():
    image = idcoder.write_file(0, 0, [1, None], [np.arange(50, dtype="<u4").tobytes(), np.array([7], "<u4").tobytes()])
    assert idcoder.read_file(image)[2] == [1, None]
    for at in (60, len(image) - 9):
        with pytest.raises(ValueError):
            idcoder.read_file(image[:at] + bytes([image[at] ^ 1]) + image[at + 1:])
