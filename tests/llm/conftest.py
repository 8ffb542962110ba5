import pytest

#: Extra columns whose names clash with what operators add.
CLASH = "n_words long, shard string, slot string, severity string, lang_pred string, findings string, licenses string, component_id string, kept string, copy string"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) rows, with clashing extra columns if asked for."""

    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        if clash:
            full = [(*r, 1, *["x"] * 9) for r in full]
            schema += ", " + CLASH
        return spark.createDataFrame(full, schema)

    return make


