"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

from corpusloom import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SOME = ["tokenize_words", "sentence_split", "ngram_bi", "log_prob", "predict_next", "delta_merge", "case_rules", "token_guards", "tfidf", "nearest", "streaks", "milestones", "stems", "known_words"]
SOME += ["typed_completions", "insertion_spacing", "caret_context", "edit_guards", "prefix_predictions", "suggestion_menu", "keys_saved", "word_standing", "sequence_scores"]
SOME += ["tag_popup", "picker_list", "dictionary_listing", "suggest_tags", "dictionary_kept", "packed_predictions", "vocabulary_after_removal", "change_feed", "one_shot_reverts", "accept_streaks"]
SOME += ["debounced_changes", "debounced_pauses", "live_document_cache", "learned_state", "maintained_lists", "maintained_continuation"]
SOME += ["alias_index", "search_titles", "sparse_nearest"]


def rows(columns, found):
    return sorted(tuple(str(x) for x in r) for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    import duckdb

    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    own = db.sql(catalog.oracle_sql()[name])
    assert columns == sorted(own.columns)
    assert rows(columns, df.select(*columns).collect()) == rows(columns, own.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
