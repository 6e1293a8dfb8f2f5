"""gridloom: gridded, vector and metro-table analytics as PySpark DataFrame operators."""
