"""vesperflow: a PySpark-native engine for sky catalogues, frames and event series."""
