"""flowlens: Spark-native network-flow analytics.

Packets and flow records in, intrusion decisions out, all as DataFrame /
Spark SQL / Spark ML / Structured Streaming work:

* ``sources``   readers, writers, table schemas, views over the driver tables
* ``functions`` Column expressions (labels, IP parsing, TCP flags, votes)
* ``operators`` DataFrame -> DataFrame operators (cleaning, flow
  segmentation, flow features, scaling, sampling, metrics, rules, models)
* ``plans``     the registered queries and their DuckDB oracle SQL
* ``streaming`` the stateful flow assembler and the micro-batch scorer
"""

from flowlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
