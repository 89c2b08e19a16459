"""English stop words.

The list is Spark's own English stop-word resource (the one ``StopWordsRemover`` uses), read from
the Spark ML jar so that no JVM is needed and the DuckDB oracle can inline the same literal list.
It is an argument everywhere it is used.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

_RESOURCE = "org/apache/spark/ml/feature/stopwords/english.txt"


@functools.lru_cache(maxsize=None)
def english_stop_words() -> tuple[str, ...]:
    import pyspark

    jars = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar")))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            if _RESOURCE in z.namelist():
                words = z.read(_RESOURCE).decode("utf-8").split()
                return tuple(dict.fromkeys(w.strip() for w in words if w.strip()))
    # Fall back to the JVM copy of the same resource.
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def sql_list(words) -> str:
    """Words as a SQL literal list: ('a', 'b', ...)."""
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
