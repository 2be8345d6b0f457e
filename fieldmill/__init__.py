"""PySpark-native operators for semi-structured, self-reported records: extract, clean, standardize, load, analyse."""
