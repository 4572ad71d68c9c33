"""PySpark-native exploratory analytics: profiles, tests, series and findings."""
