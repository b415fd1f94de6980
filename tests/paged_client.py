"""A service of pages for the tests: a SQLite file, and a log of what was asked."""

import os
import sqlite3


class Sqlite:
    def __init__(self):
        self.c = sqlite3.connect(os.environ["PAGED_FILE"], timeout=60)

    def _where(self, conditions):
        return " AND ".join(["1 = 1", *(f"{c} {sign} ?" for c, sign, _ in conditions)]), [v for *_, v in conditions]

    def ranges(self, table, key, conditions, parts):
        where, values = self._where(conditions)
        low, high = self.c.execute(f"SELECT min({key}), max({key}) FROM {table} WHERE {where}", values).fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // parts)
        return [(x, min(x + step - 1, high)) for x in range(low, high + 1, step)]

    def fetch(self, table, columns, conditions, key, limit):
        where, values = self._where(conditions)
        rows = self.c.execute(f"SELECT {', '.join(columns)} FROM {table} WHERE {where} ORDER BY {key} LIMIT ?", [*values, limit]).fetchall()
        with open(os.environ["PAGED_FILE"] + ".log", "a") as log:
            log.write(f"{len(rows)}\n")
        return rows


def client():
    return Sqlite()
