"""textloom: document analytics and retrieval operators as PySpark DataFrame functions."""
