"""Operations of a training-data pipeline: ten operators over documents, pages and vectors.

Nothing else in the library imports this subpackage.
"""
