"""Training-data operators. Nothing outside this folder imports it; queries.py registers its queries."""
