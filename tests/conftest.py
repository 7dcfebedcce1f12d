import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables aren't here")
    return DATA


NOTES = (
    "note_id bigint, path string, stem string, file_name string, mtime timestamp_ntz, ingested_at timestamp_ntz, size bigint, has_fm boolean, titulo string, tipo string, "
    "tipo_fonte string, status string, confiabilidade string, idioma string, ano string, area string, autoria string, partes string, parte string, obra string, "
    "pagina_inicio string, pagina_fim string, localizador_abrev string, resumo string, tags array<string>, hub_id string, corpo string"
)


@pytest.fixture(scope="session")
def note_rows(spark):
    """A table of notes from dicts; fields not given are null."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(NOTES)

    def make(*rows):
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)

    return make
