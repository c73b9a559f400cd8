"""shelfrank — search-relevance data engine on Spark DataFrames.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``); no operator triggers an action, creates a session or
pulls data to the driver.
"""

__version__ = "0.1.0"
