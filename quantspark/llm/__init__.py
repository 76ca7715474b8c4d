"""Training-data operators: deduplication, formatting, mixing, packing, language identification, token output, quality.

Nothing else in the library imports this subpackage.  Shared conventions:

* a *word* is a maximal run of characters other than space and U+0009..U+000D;
* a null text counts as empty, a null ``doc_id`` sorts after every other id;
* input columns that an operator does not need are never selected, so extra columns cannot clash.
"""
