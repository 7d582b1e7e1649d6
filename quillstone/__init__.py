"""Quillstone: knowledge retrieval and graph analytics as lazy PySpark plans."""
