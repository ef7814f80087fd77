"""Text analytics over Spark DataFrames: counting, collocations, language models, parsing, learners and streams."""
