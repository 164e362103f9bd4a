"""SQL equivalents of the registered queries, written apart from the Spark operators."""

from .claims import ORACLE as _claims
from .ranking import ORACLE as _ranking
from .records import ORACLE as _records
from .routing import ORACLE as _routing

ORACLE: dict[str, str] = {**_ranking, **_routing, **_claims, **_records}
