"""Registered queries: each a function (spark, folder) -> DataFrame, with its SQL where SQL can state it."""
