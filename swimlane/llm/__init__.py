"""Training-data operators: ten corpus-scale building blocks.

Each module holds one operator as a function over DataFrames.  Nothing else
in the library imports this subpackage.

Conventions shared by all of them:

* a null text counts as an empty text;
* a row whose ``doc_id`` is null cannot be named in a result: reports leave it
  out, filters let it pass;
* only the columns an operator needs are read, so extra columns (also ones that
  are called like an operator's own helper columns) never clash.
"""
