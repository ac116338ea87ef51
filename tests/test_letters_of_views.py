"""The noisy view of a record where words touch letters beyond ASCII: the same rows in Spark and in DuckDB."""

import duckdb
import pytest

from glossmill.plans import registry

TEXTS = ["Die Räder stehen. Viele Länder und Brüder der Stadt.", "éla mañade x. ende der Kette de la.", "中the cat. x́de y. _the z. the the end.", "Der Süß-éNo. Zwei. No. drei ÄDr. Vier."]


@pytest.mark.parametrize("name", ["inst_denoise", "inst_denoise_abstract", "inst_select_view", "txt_sentence_split"])
def test_noise_after_letters_beyond_ascii(spark, tmp_path, name):
    spark.createDataFrame([(i, x, "en") for i, x in enumerate(TEXTS)], "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(con.execute(registry.oracles()[name]).fetchall()) and got
