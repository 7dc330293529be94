"""The table of frequent words counts words that a batch holds only once."""

from tidemark.llm import bpe


def test_words_met_once_a_batch_are_counted(spark):
    rows = [(i, f"spread only{i} pair{i % 2} pair{i % 2}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id")
    got = [(r.word, r.n) for r in bpe.frequent_words(docs, most=4).orderBy("n", "word").collect()]
    assert got == [("only0", 1), ("pair0", 6), ("pair1", 6), ("spread", 6)]


def test_word_table_is_flat():
    import pickle

    import numpy as np
    import pyarrow as pa

    from tidemark.llm.queries import vocabulary

    ids = [[i, i + 1][:i % 3] for i in range(3000)]
    table = bpe.Table([f"w{i}" for i in range(3000)], ids)
    assert len(pickle.dumps(table)) < 40 * 3000  # some 150 bytes a word as lists of their own
    known = {f"w{i}": np.array(x, np.uint32) for i, x in enumerate(ids)}
    words = ["w5", "other", "w0", "w2999", "Straße", ""]
    want = bpe.Encoder(vocabulary("word_bpe_49k.json"), known)(words)
    flat, begin, size = table.look_up(pa.array(words), bpe.Encoder(vocabulary("word_bpe_49k.json"), {}))
    assert [flat[i:i + n].tolist() for i, n in zip(begin, size)] == [list(x) for x in want]
    assert [len(x) for x in bpe.Table([], []).look_up(pa.array(["w5", "w6"])[:0], lambda w: [])] == [0, 0, 0]
