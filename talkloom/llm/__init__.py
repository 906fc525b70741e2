"""Operators for preparing language-model training data at corpus scale.

Nothing outside this folder imports it; ``corpus_pipeline.py`` and the driver
contract use it when it is present.
"""
