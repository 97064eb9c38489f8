"""Training-data operators: licences, archives, secrets, tokens, mixing, copies, privacy, scores, rules, leaks.

Nothing outside this package imports it. Operators take DataFrames and return DataFrames; tables that
several steps read are written below the folder of `spark.checkpoint.dir` (`common.stored`).
"""
