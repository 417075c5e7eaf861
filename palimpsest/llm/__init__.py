"""Training-data operators: archives, classifiers, similarity joins, tokens.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it can be imported.
"""
