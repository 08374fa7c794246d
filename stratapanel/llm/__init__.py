"""Operations for building training corpora, each a DataFrame -> DataFrame function.

Nothing outside this package imports it.
"""
