"""Java sources of this folder as Spark functions.

Spark brings a compiler, Janino, with which it compiles its own plans. A source is compiled
by it once an application, on the driver; its classes go to the executors as a jar, as
``--jars`` would send them. Nothing has to be built or installed before.
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_loaders: dict[tuple[str, str], object] = {}


def has_compiler(spark: SparkSession) -> bool:
    """Whether Java sources can be compiled in this session's driver."""
    try:
        spark._jvm.java.lang.Class.forName("org.codehaus.janino.SimpleCompiler")
        return True
    except Exception:  # a session without a JVM, or a Spark without Janino
        return False


def _loader(spark: SparkSession, name: str):
    """What loads the classes of the source ``name`` in the driver, after executors were given them."""
    key = spark.sparkContext.applicationId, name
    if key not in _loaders:
        with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.java"), encoding="utf-8") as f:
            source = f.read()
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source)
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as jar:
            for entry in compiler.getBytecodes().entrySet():
                jar.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
        folder = tempfile.mkdtemp(prefix="chunkloom-")
        path = os.path.join(folder, f"{name}.jar")
        with open(path, "wb") as f:
            f.write(data.getvalue())
        for x in (folder, path):  # the later one is deleted first
            jvm.java.io.File(x).deleteOnExit()
        spark.sparkContext._jsc.addJar(path)  # served by the driver
        _loaders[key] = compiler.getClassLoader()
    return _loaders[key]


def java_function(spark: SparkSession, source: str, cls: str, returns: str) -> Callable[..., Column]:
    """The class ``chunkloom.SOURCE$CLS`` as a function of columns with results of a type."""
    made = _loader(spark, source).loadClass(f"chunkloom.{source}${cls}").newInstance()
    name = f"chunkloom_{source}_{cls}".lower()
    spark._jsparkSession.udf().register(name, made, spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return lambda *cols: F.call_function(name, *cols)
