"""fieldlens: field-service analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame(s) -> DataFrame`` built from
``pyspark.sql.functions``; nothing runs an action, and every time-dependent
operator takes an explicit ``as_of`` date so the same plan is reproducible.
"""

__version__ = "0.1.0"
