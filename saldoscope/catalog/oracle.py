"""Checking SQL, assembled from named fragments.

A fragment is a select; it may name other fragments in its text as ``{{name}}``. The final
text is one WITH query that holds just the fragments it needs, each once and in order.
"""

import re

FRAGMENTS: dict[str, str] = {}
_REF = re.compile(r"\{\{(\w+)\}\}")


_RANK = re.compile(r"row_number\(\) over (\((?:[^()]|\([^()]*\))*\))")


def fragment(name: str, sql: str) -> None:
    FRAGMENTS[name] = _RANK.sub(r"(row_number() over \1)::int", sql)


def build(name: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in _REF.findall(FRAGMENTS[n]):
            if dep != n:
                visit(dep)
        order.append(n)

    visit(name)
    recursive = any(re.search(r"\{\{(%s)\}\}" % n, FRAGMENTS[n]) for n in order)
    parts = ",\n".join(f"{n} as ({_REF.sub(lambda m: m.group(1), FRAGMENTS[n])})" for n in order)
    return f"with {'recursive ' if recursive else ''}{parts}\nselect * from {name}"


def any_of(text: str, words) -> str:
    return "(" + " or ".join("contains(%s, '%s')" % (text, w.replace("'", "''")) for w in words) + ")"


def first_of(text: str, words) -> str:
    return "case " + " ".join("when contains(%s, '%s') then '%s'" % (text, w.replace("'", "''"), w.replace("'", "''")) for w in words) + " end"


def by_type(limit: str, column: str = "account_type") -> str:
    from ..config.limits import ACCOUNT_TYPES, TYPE_LIMITS
    arms = " ".join(f"when '{a}' then {v}" for a, v in zip(ACCOUNT_TYPES, TYPE_LIMITS[limit]))
    return f"(case {column} {arms} end)"


def rnd(x: str, digits: int = 0) -> str:
    return f"(round_even(({x}) * {10 ** digits}.0::double, 0) / {10 ** digits}.0::double)"


def stamp(c: str = "ts") -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def day(c: str = "ts") -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def month(c: str = "ts") -> str:
    return f"strftime({c}, '%Y-%m')"


def text(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cols) + ", '')"


CP_PROFILE = text("counterparty", "description", "merchant_name")
CP_STRICT = "trim(" + text("counterparty", "merchant_name") + ")"
CP_DESC = text("counterparty", "description")
CP_DUP = "lower(trim(" + text("counterparty", "substr(description, 1, 30)") + "))"
CP_GRAPH = text("merchant_name", "counterparty", "trim(substr(trim(description), 1, 50))")
CP_SALARY = text("trim(counterparty)", "trim(merchant_name)", "trim(description)")
