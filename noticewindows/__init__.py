"""noticewindows: announcement pages to schedules of time windows, on Spark DataFrames."""

__version__ = "0.1.0"
