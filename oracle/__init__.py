"""DuckDB statements that answer the registered queries independently."""

from oracle import audit, guards, pii, traffic

ORACLE = {**pii.ORACLE, **guards.ORACLE, **traffic.ORACLE, **audit.ORACLE}
