"""Spelling expressions for the comparison SQL."""

BLANKS = "E' \\t\\r\\n'"


def address(c: str) -> str:
    t = f"trim({c}, {BLANKS})"
    return f"(CASE WHEN lower(left({t}, 3)) = 'vx1' THEN lower({t}) ELSE nullif({t}, '') END)"


def hash_(c: str) -> str:
    return f"nullif(lower(regexp_replace(trim({c}, {BLANKS}), '^0[xX]', '')), '')"


def word(c: str) -> str:
    return f"nullif(lower(trim({c}, {BLANKS})), '')"


def sats(c: str) -> str:
    return f"CAST(floor({c} * 1e8 + 0.5) AS BIGINT)"


#: Rows of address_transaction that count, each key once.
LEDGER = f"""ledger AS (
  SELECT a AS address, day, max(sats) AS sats FROM (
    SELECT {address("address")} AS a, CAST("timestamp" AT TIME ZONE 'UTC' AS DATE) AS day, "timestamp" AS ts, height, tx_n,
           CASE WHEN NOT isnan(balance_change) THEN {sats("balance_change")} END AS sats
    FROM address_transaction WHERE "timestamp" IS NOT NULL)
  WHERE a IS NOT NULL AND sats IS NOT NULL GROUP BY a, day, ts, height, tx_n)"""
CELLS = f"""{LEDGER}, cells AS (
  SELECT address, day, count(*) AS n, CAST(sum(sats) AS BIGINT) AS s FROM ledger GROUP BY ALL)"""
