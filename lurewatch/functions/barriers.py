"""Keeps costly columns from being computed twice."""

from pyspark.sql import functions as F


def computed_once(col):
    """``col``, in a form that the optimizer neither moves nor repeats.

    A filter on a computed column is pushed below its projection by repeating the column's expression
    there. For a model score that doubles the dearest step of a plan. The condition always holds, but the
    optimizer cannot know it and leaves the projection whole. (A bare ``rand() >= 0`` it does know.)
    Apply filters on other columns before.
    """
    return F.when(F.rand(0) * 2 >= 0, col)
