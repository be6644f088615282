import re

import __spark_entry__ as contract
from conftest import SMALL

COLUMNS = {
    1: "doc_id n_words n_removed kept_sha256", 2: "page_id url text n_chars", 3: "doc_id held_out lang_pred score",
    4: "doc_id fingerprint component_id", 5: "doc_id piece start length ids_crc32 sequence_id offset",
    6: "doc_id start n_tokens ids_crc32", 7: "doc_id source copy shuffle_key",
    8: "doc_id held_out n_tokens n_known train_tokens base_score score",
    9: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", 10: "query_id rank vec_id score",
    11: "doc_id n_bytes n_tokens over_limit",
    12: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", 13: "lang rank phrase a l r n score",
}


def test_each_operator_is_registered_with_its_columns(spark):
    queries = contract.queries()
    found = {int(m[1]): name for name in queries if (m := re.match(r"op(\d+)_", name))}
    assert sorted(found) == list(range(1, 14)) and "pipeline" in queries
    for n, name in found.items():
        df = queries[name](spark, SMALL)
        assert df.columns[:len(COLUMNS[n].split())] == COLUMNS[n].split() or set(COLUMNS[n].split()) <= set(df.columns)
