from helpers import rows
from pyspark.sql import functions as F

from lodeglass.functions.text import lines_of
from lodeglass.operators import chunk, parse, symbols


def test_functions_beyond_the_fiftieth_are_catalogued(spark):
    content = "\n".join(f"func f{k}(x int) int {{\n  return x\n}}" for k in range(120))
    df = spark.createDataFrame([("big.go", "go", content)], "path string, language string, content string")
    want = sorted((f"f{k}", 3 * k + 1) for k in range(120))
    assert sorted(rows(symbols.catalogue(df, ["path"]), "name", "line")) == want
    units = chunk.index_chunks(df, ["path"]).where("chunk_type = 'function'")
    assert sorted(rows(units, "identifier", "start_line")) == want
    # the report of signatures keeps its cap
    assert df.select(F.size(parse.signatures(lines_of("content"), F.col("language")))).first()[0] == 50
