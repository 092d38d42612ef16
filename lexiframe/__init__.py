"""Text representation and evaluation on Spark DataFrames.

Corpus -> sentences -> words -> vocabulary -> framed sequences -> vectors ->
classification -> staged evaluation -> experiment leaderboard.
"""
