"""Product-catalogue analytics on PySpark: extract, validate, merge, serve, account, measure."""
