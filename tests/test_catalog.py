"""Queries against their SQL at the smallest scale, and the entry without the optional subpackage."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

HERE = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(HERE))

from lexmill import catalog  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "token_metrics token_ids top_pmi_bigrams fd_subtract freq_of_freq fd_rendered cond_fd_by_tag treebank_tokens lancaster_stems trigram_measures bigram_nbest prob_ele concordance similar_words lm_kneser_ney_scores lowest_common_hypernyms stream_freqdist nb_accuracy positive_nb_scores linear_scores porter_stems ngram_freq_hash mwe_tokens prob_good_turing bleu_corpus lemmatize synset_lookup nb_probabilities feature_dict_predict fd_put fd_delete lm_perplexity cfg_chart cfg_recognize pcfg_viterbi feature_parse tree_transforms trigram_nbest quadgram_likelihood chunk_iob".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", SMALL)
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(str(plain(r[c])) for c in cols) for r in df.collect()))
    rel = con.execute(catalog.oracle_sql()[name])
    at = [[x[0] for x in rel.description].index(c) for c in cols]
    assert got == sorted(tuple(str(plain(r[i])) for i in at) for r in rel.fetchall())


def test_entry_without_optional_parts(tmp_path):
    import shutil

    shutil.copytree(HERE / "lexmill", tmp_path / "lexmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/root"})


def test_names_of_sql_are_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
