"""Co-occurrence, label counts, matrices and PMI."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalog.common import (
    BASE_SQL,
    BENCHMARK_WORDS_SQL,
    CONVERSATIONS_SQL,
    COUNT_PY_SQL,
    DW_SQL,
    ENCODED_SQL,
    LABELLED_SQL,
    MIN_COUNT,
    WINDOW,
    benchmark_words,
    conversation_sentences,
    label_counts,
    labelled,
    near_sql,
    pairs,
    pmi_sql,
    r,
    rounded,
    sentences,
    sents_sql,
    smooth_sql,
    units_sql,
    vocab_sql,
    vocabulary,
)
from tallyvec.operators.cooccurrence import word_context
from tallyvec.operators.labels import count_label_words, index_labels, label_word
from tallyvec.operators.matrix import pack_rows, sparse_encode, stack_labels, slice_matrix
from tallyvec.operators.pmi import (
    col_marginals,
    count_marginals,
    pmi_threshold,
    row_marginals,
    smooth_contexts,
    train_pmi,
    weight_by_count,
)
from tallyvec.plans.reconstruction import split_vocabulary
from tallyvec.plans.word2vec import EmbeddingParams, row_counts, word_rows
from tallyvec.sources.corpus import holdout_sentences

PRUNE_COUNT, PRUNE_POINT = 5, 1_000
HEAD = 16 << 10
THRESHOLD = math.log(10)


def _cells(df):
    return df.select("row", "col", rounded("v").alias("v"))


def _pmi_cells(df):
    return df.select("row", "col", rounded("pmi").alias("pmi"))


def _word_context(spark, sf_dir, **options):
    vocab, n_vocab = vocabulary(spark, sf_dir)
    counts = word_context(sentences(spark, sf_dir), vocab, WINDOW, n_vocab=n_vocab, **options)
    return counts.withColumn("cnt", rounded("cnt"))


def word_context_fixed(spark, sf_dir):
    return _word_context(spark, sf_dir, dynamic_weight=False)


def word_context_dynamic(spark, sf_dir):
    return _word_context(spark, sf_dir)


def word_context_rows(spark, sf_dir):
    return _word_context(spark, sf_dir, row_words=benchmark_words(spark, sf_dir))


def cooc_block_prune(spark, sf_dir):
    return _word_context(spark, sf_dir, min_count=PRUNE_COUNT, prune_point=PRUNE_POINT)


def cooc_block_prune_holdout(spark, sf_dir):
    """Sentences with rare words are left out, and the others are numbered without gaps."""
    vocab, n_vocab = vocabulary(spark, sf_dir)
    terms = vocab.filter(F.col("cnt") <= MIN_COUNT + 1).select("word")
    kept = holdout_sentences(sentences(spark, sf_dir), terms, True, n_vocab)
    counts = word_context(kept, vocab, WINDOW, n_vocab=n_vocab, min_count=PRUNE_COUNT, prune_point=PRUNE_POINT)
    return counts.withColumn("cnt", rounded("cnt"))


def word_context_head_tail(spark, sf_dir):
    """A few hundred frequent words are broadcast, all others are looked up by a join."""
    return _word_context(spark, sf_dir, head_bytes=HEAD)


def label_word_counts(spark, sf_dir):
    return label_word(labelled(spark, sf_dir), *vocabulary(spark, sf_dir))


def label_index(spark, sf_dir):
    vocab, n_vocab = vocabulary(spark, sf_dir)
    return index_labels(count_label_words(labelled(spark, sf_dir), vocab, n_vocab))[0]


def sparse_encode_labels(spark, sf_dir):
    vocab, n_vocab = vocabulary(spark, sf_dir)
    _, labels, n_labels = label_counts(spark, sf_dir)
    counts = label_word(labelled(spark, sf_dir), vocab, n_vocab)
    return _cells(
        sparse_encode(counts, labels, vocab.select("idx", "word"), n_labels, n_vocab)
    )


def packed_rows(spark, sf_dir):
    packed = pack_rows(pairs(spark, sf_dir))
    return packed.select(
        "row",
        F.size("cols").alias("n"),
        F.array_join(F.transform("cols", lambda c: c.cast("string")), " ").alias("cols"),
        rounded(F.aggregate("vals", F.lit(0.0), lambda s, v: s + v)).alias("total"),
    )


def stacked_matrix(spark, sf_dir):
    n_vocab = vocabulary(spark, sf_dir)[1]
    return _cells(stack_labels(pairs(spark, sf_dir), label_counts(spark, sf_dir)[0], n_vocab))


def matrix_slice(spark, sf_dir):
    """The train block and the test rows, the benchmark words being masked."""
    vocab, _ = vocabulary(spark, sf_dir)
    (train, n_train), (test, n_test) = split_vocabulary(vocab, benchmark_words(spark, sf_dir))
    kept, hidden = train.select("old", "idx"), test.select("old", "idx")
    ww = pairs(spark, sf_dir)
    seen = _cells(slice_matrix(ww, kept, kept, n_train, n_train))
    masked = _cells(slice_matrix(ww, hidden, kept, n_test, n_train))
    return seen.select(F.lit("train").alias("part"), "*").unionByName(
        masked.select(F.lit("test").alias("part"), "*")
    )


def pmi_marginals(spark, sf_dir):
    ww = pairs(spark, sf_dir)
    px = row_marginals(ww).select(F.lit("x").alias("axis"), F.col("row").alias("idx"), "p")
    py = col_marginals(ww).select(F.lit("y").alias("axis"), F.col("col").alias("idx"), "p")
    return px.unionByName(py).withColumn("p", F.round("p", 9))


def pmi_context_smoothing(spark, sf_dir):
    py = smooth_contexts(col_marginals(pairs(spark, sf_dir)), 0.75)
    return py.withColumn("p", F.round("p", 9))


def _train(spark, sf_dir, **options):
    n_vocab = vocabulary(spark, sf_dir)[1]
    ww = pairs(spark, sf_dir)
    return _pmi_cells(train_pmi(ww, n_rows=n_vocab, n_cols=n_vocab, **options)[0])


def pmi_alpha(spark, sf_dir):
    return _train(spark, sf_dir, alpha=0.001)


def ppmi_threshold(spark, sf_dir):
    return _train(spark, sf_dir, min_pmi=THRESHOLD)


def pmi_training(spark, sf_dir):
    """PMI as in word vector training: smoothed word counts as contexts."""
    py = count_marginals(vocabulary(spark, sf_dir)[0])
    return _train(spark, sf_dir, py=py, min_pmi=THRESHOLD, beta=0.75)


def new_rows(spark, sf_dir):
    """The benchmark words in the conversations, against the contexts of the documents."""
    vocab, n_vocab = vocabulary(spark, sf_dir)
    index, n_rows = word_rows(spark, benchmark_words(spark, sf_dir))
    params = EmbeddingParams(window=WINDOW, dynamic_weight=True)
    corpus = conversation_sentences(spark, sf_dir)
    return row_counts(corpus, index, n_rows, vocab, n_vocab, params), index, n_rows


def model_contexts(spark, sf_dir):
    return smooth_contexts(count_marginals(vocabulary(spark, sf_dir)[0]), 0.75)


def pmi_external_py(spark, sf_dir):
    rows, _, n_rows = new_rows(spark, sf_dir)
    n_vocab = vocabulary(spark, sf_dir)[1]
    return _pmi_cells(
        train_pmi(rows, model_contexts(spark, sf_dir), n_rows=n_rows, n_cols=n_vocab)[0]
    )


def pmi_freq_weighted(spark, sf_dir):
    dw, _, n_labels = label_counts(spark, sf_dir)
    n_vocab = vocabulary(spark, sf_dir)[1]
    contexts = model_contexts(spark, sf_dir)
    pmi, _ = train_pmi(dw, contexts, n_rows=n_labels, n_cols=n_vocab, keep=["v"])
    return _cells(weight_by_count(pmi))


def stacked_pmi(spark, sf_dir):
    """PMI of the stacked word and label matrix, as in label vector training."""
    n_vocab = vocabulary(spark, sf_dir)[1]
    dw, _, n_labels = label_counts(spark, sf_dir)
    n = n_vocab + n_labels
    stacked = stack_labels(pairs(spark, sf_dir), dw, n_vocab)
    return _pmi_cells(train_pmi(stacked, beta=0.75, n_rows=n, n_cols=n)[0])


QUERIES = {
    "word_context": word_context_fixed,
    "word_context_dynamic": word_context_dynamic,
    "word_context_rows": word_context_rows,
    "word_context_head_tail": word_context_head_tail,
    "cooc_block_prune": cooc_block_prune,
    "cooc_block_prune_holdout": cooc_block_prune_holdout,
    "label_word": label_word_counts,
    "label_index": label_index,
    "sparse_encode": sparse_encode_labels,
    "packed_rows": packed_rows,
    "stacked_matrix": stacked_matrix,
    "matrix_slice": matrix_slice,
    "pmi_marginals": pmi_marginals,
    "pmi_context_smoothing": pmi_context_smoothing,
    "pmi_alpha": pmi_alpha,
    "ppmi_threshold": ppmi_threshold,
    "train_pmi": pmi_training,
    "pmi_external_py": pmi_external_py,
    "pmi_freq_weighted": pmi_freq_weighted,
    "stacked_pmi": stacked_pmi,
}

_TOKENS = f"WITH {sents_sql()},{vocab_sql()},{ENCODED_SQL}"
_LABELS = f"{_TOKENS},{LABELLED_SQL},{DW_SQL}"
_STACKED = f"""{BASE_SQL},{LABELLED_SQL},{DW_SQL},
    nv AS (SELECT count(*) AS n FROM vocab),
    stacked AS (SELECT row, col, v FROM ww UNION ALL SELECT row + n, col, v FROM dw, nv
        UNION ALL SELECT col, row + n, v FROM dw, nv)"""
_OWN_PY = """
    own_py AS (SELECT col, sum(v) / (SELECT sum(v) FROM ww) AS p FROM ww GROUP BY col)"""
MODEL_PY_SQL = f"{COUNT_PY_SQL},{smooth_sql('model_py', 'raw_py')}"
CUT = repr(pmi_threshold(THRESHOLD))

NEW_ROWS_SQL = f"""{CONVERSATIONS_SQL},{BENCHMARK_WORDS_SQL},
    bindex AS (SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS INT) AS row, word FROM bwords),
    cenc AS (SELECT doc_id, sent_no, pos, idx FROM ctoks JOIN vocab USING (word)),
    crow AS (SELECT doc_id, sent_no, pos, row FROM ctoks JOIN bindex USING (word)),
    new_ww AS (SELECT a.row, b.idx AS col, {units_sql()} / {float(WINDOW)} AS v
        FROM {near_sql('crow', 'cenc')} GROUP BY a.row, b.idx)"""


def _pruned_sql(before: str, numbered: str) -> str:
    """A literal replay, block by block: running count, dropped at a boundary if too small."""
    return f"""WITH RECURSIVE {sents_sql()},{vocab_sql()},{before}
        numbered AS (SELECT doc_id, sent_no, row_number() OVER (ORDER BY doc_id, sent_no) - 1 AS i FROM {numbered}),
        blocks AS (SELECT doc_id, sent_no, i // {PRUNE_POINT} AS block, (SELECT max(i) // {PRUNE_POINT} FROM numbered) AS last
            FROM numbered),
        benc AS (SELECT doc_id, sent_no, pos, idx, block, last FROM toks JOIN vocab USING (word)
            JOIN blocks USING (doc_id, sent_no)),
        counts AS (SELECT a.idx AS row, b.idx AS col, a.block, a.last, {units_sql()} AS units
            FROM {near_sql('benc', 'benc')} GROUP BY a.idx, b.idx, a.block, a.last),
        lists AS (SELECT row, col, any_value(last) AS last, list(block ORDER BY block) AS bs, list(units ORDER BY block) AS us
            FROM counts GROUP BY row, col),
        run AS (SELECT row, col, last, bs, us, 1 AS k,
                CASE WHEN bs[1] < last AND us[1] < {PRUNE_COUNT * WINDOW} THEN 0 ELSE us[1] END AS total FROM lists
            UNION ALL
            SELECT row, col, last, bs, us, k + 1,
                CASE WHEN bs[k + 1] < last AND total + us[k + 1] < {PRUNE_COUNT * WINDOW} THEN 0 ELSE total + us[k + 1] END
            FROM run WHERE k < len(bs))
        SELECT x.word, y.word AS context, {r(f'total / {float(WINDOW)}')} AS cnt
        FROM run JOIN vocab x ON x.idx = row JOIN vocab y ON y.idx = col WHERE k = len(bs) AND total > 0"""


def _words_sql(weight: str) -> str:
    return f"""{_TOKENS},
    counts AS (SELECT a.idx AS row, b.idx AS col, {weight} AS w FROM {near_sql('enc', 'enc')} GROUP BY a.idx, b.idx)
    SELECT x.word, y.word AS context, {r('w')} AS cnt FROM counts JOIN vocab x ON x.idx = row JOIN vocab y ON y.idx = col"""


ORACLES = {
    "word_context": _words_sql("count(*)"),
    "word_context_dynamic": _words_sql(f"{units_sql()} / {float(WINDOW)}"),
    "word_context_rows": f"""{_TOKENS},{BENCHMARK_WORDS_SQL},
        rowtoks AS (SELECT * FROM toks WHERE word IN (SELECT word FROM bwords)),
        ctx AS (SELECT doc_id, sent_no, pos, word FROM toks WHERE word IN (SELECT word FROM vocab))
        SELECT a.word, b.word AS context, {r(f'{units_sql()} / {float(WINDOW)}')} AS cnt
        FROM {near_sql('rowtoks', 'ctx')} GROUP BY a.word, b.word""",
    "word_context_head_tail": _words_sql(f"{units_sql()} / {float(WINDOW)}"),
    "cooc_block_prune": _pruned_sql("", "sents"),
    "cooc_block_prune_holdout": _pruned_sql(
        f"""terms AS (SELECT word FROM vocab WHERE cnt <= {MIN_COUNT + 1}),
        hits AS (SELECT DISTINCT doc_id, sent_no FROM toks WHERE word IN (SELECT word FROM terms)),
        train AS (SELECT s.* FROM sents s LEFT JOIN hits ON hits.doc_id = s.doc_id AND hits.sent_no = s.sent_no
            WHERE hits.doc_id IS NULL),""", "train"),
    "label_word": f"""{_LABELS}
        SELECT label, word, lcounts.cnt FROM lcounts JOIN vocab ON vocab.idx = lcounts.col""",
    "label_index": f"{_LABELS} SELECT idx, label FROM labs",
    "sparse_encode": f"{_LABELS} SELECT row, col, {r('v')} AS v FROM dw",
    "packed_rows": f"""{BASE_SQL}
        SELECT row, CAST(count(*) AS INT) AS n, string_agg(CAST(col AS VARCHAR), ' ' ORDER BY col) AS cols,
            {r('sum(v)')} AS total FROM ww GROUP BY row""",
    "stacked_matrix": f"{_STACKED} SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, {r('v')} AS v FROM stacked",
    "matrix_slice": f"""{BASE_SQL},{BENCHMARK_WORDS_SQL},
        train AS (SELECT idx AS old, CAST(row_number() OVER (ORDER BY idx) - 1 AS INT) AS new FROM vocab
            WHERE word NOT IN (SELECT word FROM bwords)),
        test AS (SELECT idx AS old, CAST(row_number() OVER (ORDER BY idx) - 1 AS INT) AS new FROM vocab
            WHERE word IN (SELECT word FROM bwords))
        SELECT 'train' AS part, x.new AS row, y.new AS col, {r('v')} AS v FROM ww
            JOIN train x ON x.old = row JOIN train y ON y.old = col
        UNION ALL SELECT 'test', x.new, y.new, {r('v')} FROM ww
            JOIN test x ON x.old = row JOIN train y ON y.old = col""",
    "pmi_marginals": f"""{BASE_SQL}, total AS (SELECT sum(v) AS t FROM ww)
        SELECT 'x' AS axis, row AS idx, round(sum(v) / any_value(t), 9) AS p FROM ww, total GROUP BY row
        UNION ALL SELECT 'y', col, round(sum(v) / any_value(t), 9) FROM ww, total GROUP BY col""",
    "pmi_context_smoothing": f"""{BASE_SQL},{_OWN_PY},{smooth_sql('py', 'own_py')}
        SELECT col, round(p, 9) AS p FROM py""",
    "pmi_alpha": f"""{BASE_SQL},{_OWN_PY},{pmi_sql('pm', 'ww', 'own_py', alpha=0.001)}
        SELECT row, col, {r('pmi')} AS pmi FROM pm""",
    "ppmi_threshold": f"""{BASE_SQL},{_OWN_PY},{pmi_sql('pm', 'ww', 'own_py', CUT)}
        SELECT row, col, {r('pmi')} AS pmi FROM pm""",
    "train_pmi": f"""{BASE_SQL},{MODEL_PY_SQL},{pmi_sql('pm', 'ww', 'model_py', CUT)}
        SELECT row, col, {r('pmi')} AS pmi FROM pm""",
    "pmi_external_py": f"""{_TOKENS},{MODEL_PY_SQL},{NEW_ROWS_SQL},{pmi_sql('pm', 'new_ww', 'model_py')}
        SELECT row, col, {r('pmi')} AS pmi FROM pm""",
    "pmi_freq_weighted": f"""{_LABELS},{MODEL_PY_SQL},{pmi_sql('pm', 'dw', 'model_py', extra=', v')}
        SELECT row, col, {r('v * pmi')} AS v FROM pm""",
    "stacked_pmi": f"""{_STACKED},
        own_py AS (SELECT col, sum(v) / (SELECT sum(v) FROM stacked) AS p FROM stacked GROUP BY col),
        {smooth_sql('py', 'own_py')},{pmi_sql('pm', 'stacked', 'py')}
        SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, {r('pmi')} AS pmi FROM pm""",
}
