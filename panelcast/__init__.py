"""Panel time-series analytics on Spark.

Every public function takes DataFrames and returns DataFrames; nothing here owns
a session or runs an action unless its name says write.
"""

import sys

from pyspark import cloudpickle

# Executors run the grouped fits without this package installed: its functions
# travel inside the task closure.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from panelcast.spec import FLAGS, MEASURES, PanelSpec  # noqa: E402

__all__ = ["FLAGS", "MEASURES", "PanelSpec"]
