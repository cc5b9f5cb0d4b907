"""Steps on tables whose columns are made once and used for many tables of one shape.

Making the columns of a long chain of steps costs more than a second, which is most of the time of a small batch.
"""

from pyspark.sql import DataFrame


class Steps:
    """In place of a table, it notes the steps that are taken on it; ``on`` takes them on another one.

    The steps have to name columns by text or ``F.col``, not by a table.
    """

    def __init__(self, frame: DataFrame, taken: tuple = ()):
        self._frame, self._taken = frame, taken

    def __getattr__(self, name: str):
        found = getattr(self._frame, name)
        if not callable(found):
            return found

        def step(*args, **named) -> "Steps":
            return Steps(found(*args, **named), (*self._taken, (name, args, named)))

        return step

    def on(self, frame: DataFrame) -> DataFrame:
        for name, args, named in self._taken:
            frame = getattr(frame, name)(*args, **named)
        return frame
