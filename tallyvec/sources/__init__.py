from tallyvec.sources.corpus import (
    corpus_length,
    drop_stopwords,
    holdout_sentences,
    labelled_sentences,
    limit_documents,
    read_text_corpus,
    read_word_list,
    scan_corpus,
    tokenize_sentences,
)
from tallyvec.sources.stage import write_stage
from tallyvec.sources.store import load_tables, save_tables

__all__ = [
    "corpus_length",
    "drop_stopwords",
    "holdout_sentences",
    "labelled_sentences",
    "limit_documents",
    "load_tables",
    "read_text_corpus",
    "read_word_list",
    "save_tables",
    "scan_corpus",
    "tokenize_sentences",
    "write_stage",
]
