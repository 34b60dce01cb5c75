"""innlytics: hotel reservation analytics as Spark DataFrame operators.

Every operator takes a :class:`innlytics.sources.tables.Tables` bundle of
DataFrames and returns a DataFrame; nothing is collected to the driver.
"""

from innlytics.session import build_session, checkpoint_dir  # noqa: F401
from innlytics.sources.tables import Tables  # noqa: F401
