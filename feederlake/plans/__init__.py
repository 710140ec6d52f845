"""The data products and the queries that are answered from them."""
