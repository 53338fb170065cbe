"""Sources, tokenising and the vocabulary."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.common import (
    BENCHMARK_WORDS_SQL,
    ENCODED_SQL,
    MIN_COUNT,
    benchmark_words,
    documents,
    labelled,
    sentences,
    sents_sql,
    table,
    vocab_sql,
    vocabulary,
)
from tallyvec.operators.vocabulary import (
    decode_words,
    encode_words,
    index_sentences,
    scan_vocabulary,
)
from tallyvec.sources.corpus import (
    corpus_length,
    distinct_words,
    drop_stopwords,
    holdout_sentences,
    limit_documents,
    scan_corpus,
)
from tallyvec.sources.stage import shared_folder
from tallyvec.sources.store import load_tables, save_tables

STOPWORDS = ["the", "of", "de", "and"]


def _joined(df):
    return df.select("doc_id", "sent_no", F.array_join("words", " ").alias("words"))


def corpus_scan(spark, sf_dir):
    return scan_corpus(documents(spark, sf_dir)).select("doc_id", "text")


def doc_limit(spark, sf_dir):
    return scan_corpus(limit_documents(documents(spark, sf_dir), 100)).select("doc_id", "text")


def sentence_tokenize(spark, sf_dir):
    return _joined(sentences(spark, sf_dir))


def corpus_len(spark, sf_dir):
    return corpus_length(documents(spark, sf_dir))


def labelled_corpus(spark, sf_dir):
    return labelled(spark, sf_dir).select(
        "doc_id",
        "sent_no",
        F.array_join("labels", " ").alias("labels"),
        F.array_join("words", " ").alias("words"),
    )


def holdout_split(spark, sf_dir):
    """The rare words of the vocabulary are the test terms."""
    vocab, n_vocab = vocabulary(spark, sf_dir)
    terms = vocab.filter(F.col("cnt") <= MIN_COUNT + 1).select("word")
    sents = sentences(spark, sf_dir)
    train = holdout_sentences(sents, terms, True, n_vocab).select(F.lit(True).alias("training"), "*")
    infer = holdout_sentences(sents, terms, False, n_vocab).select(F.lit(False).alias("training"), "*")
    return train.unionByName(infer).select("training", "doc_id", "sent_no")


def stopword_tokenize(spark, sf_dir):
    return _joined(drop_stopwords(sentences(spark, sf_dir), STOPWORDS))


def wordlist_scan(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(
        F.explode(F.split("text", "\n")).alias("word")
    )
    return distinct_words(lines)


def model_save_load(spark, sf_dir):
    folder = f"{shared_folder(spark)}/tallyvec/saved-{uuid.uuid4().hex}"
    save_tables({"vocab": vocabulary(spark, sf_dir)[0]}, folder)
    return load_tables(spark, folder, ["vocab"])["vocab"].select("idx", "word", "cnt")


def vocab_scan(spark, sf_dir):
    return scan_vocabulary(sentences(spark, sf_dir), MIN_COUNT)


def vocab_index(spark, sf_dir):
    return vocabulary(spark, sf_dir)[0]


def vocab_encode(spark, sf_dir):
    vocab, n_vocab = vocabulary(spark, sf_dir)
    tokens = sentences(spark, sf_dir).select("doc_id", "sent_no", F.explode("words").alias("word"))
    encoded = encode_words(tokens, vocab, n_vocab)
    return encoded.groupBy("doc_id", "idx").agg(F.count(F.lit(1)).alias("n"))


def vocab_decode(spark, sf_dir):
    """The benchmark words that the vocabulary knows, there and back."""
    vocab, n_vocab = vocabulary(spark, sf_dir)
    encoded = encode_words(benchmark_words(spark, sf_dir), vocab, n_vocab)
    return decode_words(encoded.withColumn("code", F.col("idx")), vocab, n_vocab)


def sentence_index(spark, sf_dir):
    return index_sentences(sentences(spark, sf_dir))[0].select("doc_id", "sent_no", "i_sent")


QUERIES = {
    f.__name__: f
    for f in (
        corpus_scan,
        doc_limit,
        sentence_tokenize,
        corpus_len,
        labelled_corpus,
        holdout_split,
        stopword_tokenize,
        wordlist_scan,
        model_save_load,
        vocab_scan,
        vocab_index,
        vocab_encode,
        vocab_decode,
        sentence_index,
    )
}

_SENTS = f"WITH {sents_sql()}"
_VOCAB = f"{_SENTS},{vocab_sql()}"

ORACLES = {
    "corpus_scan": f"{_SENTS} SELECT doc_id, t AS text FROM docs WHERE t <> ''",
    "doc_limit": f"{_SENTS} SELECT doc_id, t AS text FROM docs WHERE t <> '' AND doc_id < 100",
    "sentence_tokenize": f"""{_SENTS}
        SELECT doc_id, sent_no, array_to_string(words, ' ') AS words FROM sents""",
    "corpus_len": "SELECT count(*) AS n_docs FROM documents",
    "labelled_corpus": f"""{_SENTS}
        SELECT doc_id, sent_no, array_to_string(words, ' ') AS words,
            CASE WHEN lang = 'de' THEN '__doc' || doc_id || '__' ELSE lower(source) || ' ' || lower(lang) END AS labels
        FROM sents JOIN documents USING (doc_id)""",
    "holdout_split": f"""{_VOCAB},
        terms AS (SELECT word FROM vocab WHERE cnt <= {MIN_COUNT + 1}),
        hits AS (SELECT DISTINCT doc_id, sent_no FROM toks WHERE word IN (SELECT word FROM terms))
        SELECT hits.doc_id IS NULL AS training, s.doc_id, s.sent_no
        FROM sents s LEFT JOIN hits ON hits.doc_id = s.doc_id AND hits.sent_no = s.sent_no""",
    "stopword_tokenize": f"""{_SENTS}
        SELECT doc_id, sent_no, array_to_string(list_filter(words, lambda x: x NOT IN ({
            ', '.join(repr(w) for w in STOPWORDS)})), ' ') AS words FROM sents""",
    "wordlist_scan": """SELECT DISTINCT word FROM (
        SELECT regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS word
        FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations)) WHERE word <> ''""",
    "model_save_load": f"{_VOCAB} SELECT idx, word, cnt FROM vocab",
    "vocab_scan": f"{_VOCAB} SELECT word, cnt FROM vocab",
    "vocab_index": f"{_VOCAB} SELECT idx, word, cnt FROM vocab",
    "vocab_encode": f"""{_VOCAB},{ENCODED_SQL}
        SELECT doc_id, idx, count(*) AS n FROM enc GROUP BY doc_id, idx""",
    "vocab_decode": f"""{_VOCAB},{BENCHMARK_WORDS_SQL}
        SELECT idx AS code, word FROM vocab JOIN bwords USING (word)""",
    "sentence_index": f"""{_SENTS}
        SELECT doc_id, sent_no, row_number() OVER (ORDER BY doc_id, sent_no) - 1 AS i_sent FROM sents""",
}
