"""CRC-32 of texts in SQL, for the SQL twins of queries that hash by it."""

#: A table of one row: ``crc``, the 256 remainders.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc FROM range(256) r(i))"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an expression's UTF-8 bytes; ``crc_table`` must be joined."""
    byte = f"('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT"
    step = "lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_transform(range(strlen({text})), lambda i: {byte}), {step}, 4294967295), 4294967295)"
