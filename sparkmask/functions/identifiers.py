"""Names of columns as Spark reads them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the longest name that is taken for one.
LONGEST = 128


def quoted(name: str) -> str:
    """The name in backticks, those inside it doubled, so that it can't end early; blank names and NUL are refused."""
    if not name.strip():
        raise ValueError("a name is blank")
    if "\0" in name:
        raise ValueError("a name holds a NUL character")
    if len(name) > LONGEST:
        raise ValueError(f"a name has {len(name)} characters, and {LONGEST} are allowed")
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))
