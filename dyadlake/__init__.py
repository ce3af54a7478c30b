"""Relational-behaviour analytics and corpus operators as PySpark DataFrame functions."""
