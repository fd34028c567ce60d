"""The native operator runs no Python on the executors."""

import re

from ravelin.llm import mixing


def test_mixing_is_native(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for df in (mixing.mixed(docs), mixing.resampled(docs)):
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert not re.search(r"Python|Arrow|Pandas|CartesianProduct", plan)
