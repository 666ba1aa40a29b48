"""Row keys: which types can be written into a value, and how wide their text gets."""

from collections.abc import Sequence

from pyspark.sql import types as T

from .meta import ColumnMeta

# Widest text of a key's type; other types count their declared length or OTHER.
TINY, SMALL, INT, BIG, UUID, OTHER = 3, 6, 11, 20, 32, 32
EMAIL_OVERHEAD = 25


def width(kind: T.DataType | ColumnMeta) -> int:
    meta = kind if isinstance(kind, ColumnMeta) else ColumnMeta("", kind)
    if meta.unsigned or isinstance(meta.data_type, T.ByteType):
        return TINY if meta.unsigned else 4
    for t, n in ((T.ShortType, SMALL), (T.IntegerType, INT), (T.LongType, BIG)):
        if isinstance(meta.data_type, t):
            return n
    return UUID if meta.uuid else meta.max_length or OTHER


def max_width(kinds: Sequence[T.DataType | ColumnMeta]) -> int:
    """Of all parts and the hyphens between them."""
    return sum(map(width, kinds)) + max(0, len(kinds) - 1)


def spliceable(column: ColumnMeta) -> bool:
    """Whole numbers can be joined by hyphens and told apart again."""
    return isinstance(column.data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def renderable(column: ColumnMeta) -> bool:
    """Whether the key has a text that an address can hold and that the sweep recognises: whole numbers and UUIDs."""
    return spliceable(column) or column.uuid
