import numpy as np

import __spark_entry__ as E
from haze.llm import token_files
from haze.llm.catalog import tokenizer_file

SF = "/root/testdata/sf0.001"


def lengths(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    tok.encode_special_tokens = True
    return [len(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query_equals_the_tokenizer(spark, docs):
    got = {r["doc_id"]: r["n_tokens"] for r in E.queries()["op3_token_counts"](spark, SF).collect()}
    assert got == dict(zip(docs, lengths(docs.values())))


def test_blocks_stitch_at_every_boundary(spark, tmp_path):
    rng = np.random.default_rng(4)
    want, paths = {}, []
    for k, sizes in enumerate([[], [0], [0, 0, 3], [40, 1, 0, 17], [100], list(rng.integers(0, 9, 50))]):
        for tail in (0, 5):
            ids = [x for n in sizes for x in [1 + i % 6 for i in range(n)] + [7]] + [2] * tail
            path = str(tmp_path / f"{k}-{tail}.tokens")
            np.asarray(ids, "<u4").tofile(path)
            paths.append((path,))
            at = 0
            for o, n in enumerate(sizes):
                want[path, o] = (at, n, True)
                at += n + 1
            if tail:
                want[path, len(sizes)] = (at, tail, False)
    files = spark.createDataFrame(paths + paths[:2], "path string")
    for block in (1, 3, 7, 1000):
        got = token_files.count_tokens(files, 7, width=4, block=block).collect()
        assert {(r["path"], r["ordinal"]): (r["start"], r["n_tokens"], r["terminated"]) for r in got} == want
        assert len(got) == len(want)


def test_edges(spark, tmp_path):
    rows = [(1, None, "p"), (None, "", "p"), (2, "x <|endoftext|> y", "p"), (2, "x <|endoftext|> y", "p"), (3, "word " * 5000, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = token_files.counts_through_files(df, str(tmp_path / "a"), tokenizer_file(), 49407).collect()
    assert sorted(map(tuple, got), key=str) == sorted(zip([r[0] for r in rows], lengths([r[1] for r in rows])), key=str)
    assert token_files.counts_through_files(df.limit(0), str(tmp_path / "b"), tokenizer_file(), 49407).count() == 0
