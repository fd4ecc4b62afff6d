"""foreledger: ordered event groups and honest forecast scoring on Spark.

Every public function takes and returns DataFrames (or Columns).  Work is
declared with the DataFrame API; nothing sized by the data reaches the driver.
"""

SCHEMA_VERSION = "1.1.0"
PINNED_DATA_VERSION = "1.2.0"
