"""rowmend: cleaning and re-estimating tall numeric tables with Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry the code they need, so the package only has to be installed on the driver.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
