import datetime
import hashlib
import hmac
import re
import time

from speechlake.llm.pseudonyms import pseudonymised

KEY = "test key"


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def mod97(s):
    s = re.sub(r"\W", "", s)
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def run(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [x for x in sorted(pseudonymised(df, key).collect(), key=lambda x: x.doc_id)]


def test_formats_and_validity(spark):
    texts = {
        "n_card": ["4785380592391139", "4785 3805 9239 1139", "4785-3805-9239-1139", "378282246310005"],
        "n_email": ["jane.doe+x1@mail5.example.com"],
        "n_ip": ["152.143.123.131", "8.8.8.8"],
        "n_phone": ["+1 (988) 555-2485", "(988) 555-2485", "988-555-2485", "+49 30 1234567"],
        "n_ssn": ["123-45-6789", "899-99-9999"],
        "n_date": ["1985-03-12", "12.03.1985", "03/12/1985", "13/03/1985", "2099-12-31", "1700-01-01", "2000/2/29"],
        "n_iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"],
    }
    flat = [(k, v) for k, vs in texts.items() for v in vs]
    got = run(spark, [f"é {v}, and {v}" for _, v in flat])
    out = {}
    for (kind, v), x in zip(flat, got, strict=True):
        assert x[kind] == 2 and sum(x[2:]) == 2, (v, x)
        m = re.fullmatch("é (.+), and (.+)", x.text)
        assert m[1] == m[2] != v
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+" if kind in ("n_ip",) else r"\d", "9", m[1]))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+" if kind in ("n_ip",) else r"\d", "9", v))) or kind == "n_date" and "2/29" in v
        out[v] = m[1]
    assert all(luhn(out[v]) for v in texts["n_card"])
    assert all(mod97(out[v]) == 1 for v in texts["n_iban"])
    assert len({re.sub(r"\D", "", out[v]) for v in texts["n_card"][:3]}) == 1
    assert len({re.sub(r"\D", "", out[v])[-10:] for v in texts["n_phone"][:3]}) == 1
    days = {datetime.date(*map(int, out["1985-03-12"].split("-"))), datetime.date(*map(int, out["12.03.1985"].split(".")[::-1]))}
    month, day, year = map(int, out["03/12/1985"].split("/"))
    assert days == {datetime.date(year, month, day)}
    assert out["DE89370400440532013000"] == out["DE89 3704 0044 0532 0130 00"].replace(" ", "")


def test_what_is_invalid_stays(spark):
    texts = ["4785380592391138", "999.1.1.1", "1.2.3.4.5", "2023-13-45", "31.02.2020", "000-12-3456", "666-12-3456", "DE89370400440532013001", "188-155-2485", "no numbers", "a@b", "v1.2.3", "0000000000000000", "x4785380592391139", "47853805923911390000000"]
    got = run(spark, texts)
    assert [x.text for x in got] == texts and all(sum(x[2:]) == 0 for x in got)


def test_permutation_and_key(spark):
    octets = [f"10.0.0.{i}" for i in range(256)]
    days = [(datetime.date(2000, 1, 1) + datetime.timedelta(i)).isoformat() for i in range(400)]
    ssn = [f"{a:03d}-{g:02d}-0001" for a in (1, 665, 667, 899) for g in range(1, 100)]
    new = [x.text for x in run(spark, octets + days + ssn)]
    got = new[:256]
    assert len(set(got)) == 256 and not set(got) & set(octets)
    assert all(a.text != b for a, b in zip(run(spark, octets[:20], "other"), got, strict=False))
    assert len(set(new[256:656])) == 400
    got = new[656:]
    assert len(set(got)) == len(ssn) and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in got)


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "8.8.8.8", "k"), (1, None, "k"), (2, "", "k"), (3, "4785380592391139$$$ " * 300 + "w " * 200_000, None), (3, "x", "y"), (3, "x", "y")], "doc_id long, text string, finds string")
    rows = pseudonymised(df, KEY).collect()
    got = {(x.doc_id, x.n_card, x.n_ip): x.text for x in rows}
    assert got[1, 0, 0] is None and got[2, 0, 0] == "" and got[3, 300, 0].endswith("w w ") and "4785380592391139" not in got[3, 300, 0] and got[3, 0, 0] == "x" and (None, 0, 1) in got
    assert len(rows) == 6 and pseudonymised(df.limit(0), KEY).count() == 0


def test_cards_among_other_numbers(spark):
    plain, spaced, hyphens, amex = "4785380592391139", "4785 3805 9239 1139", "4785-3805-9239-1139", "3782 822463 10005"
    new = {x: y.text for x, y in zip((plain, spaced, hyphens, amex), run(spark, [plain, spaced, hyphens, amex]), strict=True)}
    assert all(x != y for x, y in new.items())
    texts = {
        "{0} {0}": 2, "{1} {1}": 2, "{1} {0} {2} {3}": 4, "{0}-{0}": 2, "{2}-{2}": 2, "{3} {3}": 2,
        "card {0} 12/27": 1, "card {1} 12/27, 123": 1, "card {0} 123": 1, "card {2} 123": 1, "card {3} 1234": 1, "{1} 2027": 1, "2027 {1}": 1,
        "qty 2 {0}": 1, "qty 2-{0}": 1, "qty 2 {1}": 1, "12 34 {3} 5 {0} 6": 2, "1234 5679 {1} 9": 1, "{0} 12ab": 1, "OF12 {1}": 1,
        "\x01\x03 {0} \x01 {0} 5\x01\x02": 2, "2 {0} " * 300: 300, "7 " * 100_000 + "{0}": 1,
    }
    others = {"{} 8.8.8.8": "n_ip", "{} 1985-03-12": "n_date", "1985-03-12 {}": "n_date", "{} 123-45-6789": "n_ssn", "{} 988-555-2485": "n_phone", "+49 30 12345 {}": "n_phone", "{} a@b.org": "n_email", "{} DE89370400440532013000": "n_iban"}
    beside = [(t, kind, card) for card in (plain, spaced) for t, kind in others.items()]
    got = run(spark, [t.format(plain, spaced, hyphens, amex) for t in texts] + [t.format(card) for t, _, card in beside])
    for (t, n), x in zip(texts.items(), got, strict=False):
        assert x.text == t.format(*new.values()) and x.n_card == n and sum(x[2:]) == n, (t[:80], x.text[:200])
    for (t, kind, card), x in zip(beside, got[len(texts) :], strict=True):
        assert x.n_card == 1 and x[kind] == 1 and sum(x[2:]) == 2 and new[card] in x.text, (t, x)
        assert not any(w in x.text for w in t.split() if w not in ("{}", "+49", "30")), (t, x)


def test_numbers_beside_cards_stay(spark):
    texts = ["1 " * 5000, " ".join(map(str, range(1985, 1996))), "0.4785380592391139", "4785380592391138 12", "+4785380592391139123"]
    assert [x.text for x in run(spark, texts)] == texts


def test_time_after_a_date(spark):
    day, stamp, word = run(spark, ["1985-03-12", "1985-03-12T10:15:00Z", "1985-03-12Tx"])
    assert stamp.text == day.text + "T10:15:00Z" and stamp.n_date == 1 and word.n_date == 0


def plain_permuted(elements, radices, key, kind):
    """The Feistel network in plain Python."""
    k = hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()
    half = max(1, len(elements) // 2)
    left, right, rl, rr = elements[:half], elements[half:], radices[:half], radices[half:]

    def add(part, other, r, own):
        said = "|".join([k, str(r), str(len(part)), ",".join(map(str, other))])
        return [(x + int(hashlib.sha256(f"{said}|{i}".encode()).hexdigest()[:14], 16)) % own[i] for i, x in enumerate(part)]

    for r in range(8):
        if r % 2 == 0:
            left = add(left, right, r, rl)
        else:
            right = add(right, left, r, rr)
    return left + right


def refill(shape, fill):
    fill = iter(fill)
    return "".join(next(fill) if c.isalnum() else c for c in shape)


def plain(kind, s, key=KEY):
    if kind == "card":
        d = [int(c) for c in s if c.isdigit()][:-1]
        body = "".join(map(str, plain_permuted(d, [10] * len(d), key, kind)))
        return refill(s, next(body + str(c) for c in range(10) if luhn(body + str(c))))
    if kind == "ssn":
        a, g, n = map(int, s.split("-"))
        a, g, n = plain_permuted([a - (2 if a > 666 else 1), g - 1, n - 1], [898, 99, 9999], key, kind)
        return f"{a + (2 if a >= 665 else 1):03d}-{g + 1:02d}-{n + 1:04d}"
    if kind == "ip":
        return ".".join(map(str, plain_permuted([int(x) for x in s.split(".")], [256] * 4, key, kind)))
    if kind == "phone":
        d = [int(c) for c in s if c.isdigit()]
        low = [2 if i in (0, 3) else 0 for i in range(10)]
        new = plain_permuted([x - y for x, y in zip(d[-10:], low)], [10 - y for y in low], key, kind)
        return refill(s, "".join(map(str, d[:-10] + [x + y for x, y in zip(new, low)])))
    if kind == "date":
        y, m, d = map(int, s.split("-"))
        n = (datetime.date(y, m, d) - datetime.date(1700, 1, 1)).days
        a, b = plain_permuted([n // 773, n % 773], [189, 773], key, kind)
        return (datetime.date(1700, 1, 1) + datetime.timedelta(773 * a + b)).isoformat()
    if kind == "iban":
        bare = s.replace(" ", "")
        kinds = ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in bare[4:]]
        new = plain_permuted([k.index(c) for k, c in zip(kinds, bare[4:])], [len(k) for k in kinds], key, kind)
        body = "".join(k[x] for k, x in zip(kinds, new))
        return refill(s, f"{bare[:2]}{98 - mod97(bare[:2] + '00' + body):02d}{body}")
    local, domain = s.split("@")
    kinds = ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "abcdefghijklmnopqrstuvwxyz" for c in local if c.isalnum()]
    bare = [c for c in local if c.isalnum()]
    new = plain_permuted([k.index(c) for k, c in zip(kinds, bare)], [len(k) for k in kinds], key, kind)
    return refill(local, [k[x] for k, x in zip(kinds, new)]) + "@" + domain


VALUES = {
    "card": ["4785380592391139", "4785 3805 9239 1139", "4785-3805-9239-1139", "3782 822463 10005", "4111111111111111", "4111 1111 1111 1111"],
    "ssn": ["078-05-1120", "123-45-6789"],
    "ip": ["152.143.123.131"],
    "phone": ["988-555-2485", "(988) 555-2485"],
    "date": ["1985-03-12", "2023-04-05"],
    "iban": ["BE68 5390 0754 7034", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"],
    "email": ["Jane.Doe+x1@mail5.example.com"],
}
LEADS = ["", "Order 12 ", "item 7 ", "ref 12-", "x1-", "OF12 ", "(", "no. 3: ", "CALL ", "AB12 ", "/", "é", "7/"]
TRAILS = ["", " 12", " 12/27", "-3", " CALL me", " ME", ",", ". 7", " IN 12", " 2027", "/x", ")", " 5-7"]


def test_valid_values_among_neighbours(spark):
    cases = [(kind, v, a, b) for kind, own in VALUES.items() for v in own for a in LEADS for b in TRAILS]
    cases = [c for c in cases if not (c[0] == "email" and (c[2][-1:] == "-" or c[3][:1] == "-"))]  # such signs belong to the address
    more = ["2023-04-05T10:00", "BE68 5390 0754 7034 DE89 3704 0044 0532 0130 00 CALL", "BE68 5390 0754 7034 4111 1111 1111 1111"]
    got = run(spark, [a + v + b for _, v, a, b in cases] + more)
    wrong = [(a + v + b, x.text) for (kind, v, a, b), x in zip(cases, got, strict=False) if x.text != a + plain(kind, v) + b or x[f"n_{kind}"] != 1]
    assert wrong == []
    assert [x.text for x in got[len(cases) :]] == [
        plain("date", "2023-04-05") + "T10:00",
        plain("iban", "BE68 5390 0754 7034") + " " + plain("iban", "DE89 3704 0044 0532 0130 00") + " CALL",
        plain("iban", "BE68 5390 0754 7034") + " " + plain("card", "4111 1111 1111 1111"),
    ]


def test_invalid_values_among_neighbours_stay(spark):
    bad = ["4785380592391138", "4785-3805-9239-1138", "000-12-3456", "666-12-3456", "999.1.1.1", "1.2.3.4.5", "2023-13-45", "31.02.2020", "DE89370400440532013001", "188-155-2485", "a@b"]
    texts = [a + v + b for v in bad for a in ("", "Order ", "(", "no. x: ", "CALL ") for b in ("", ",", " CALL me", ")", "; x")]
    assert [x.text for x in run(spark, texts)] == texts


def test_addresses_beside_groups(spark):
    texts = ["AB12 JANE@x.org", "4785380592391139 77@x.org", "AB12 3782 822463 10005", "OF12 4111 1111 1111 1111 CALL"]
    own = [(plain("email", "JANE@x.org"), 0), (plain("card", "4785380592391139") + " " + plain("email", "77@x.org"), 1), (plain("card", "3782 822463 10005"), 1), (plain("card", "4111 1111 1111 1111"), 1)]
    for t, x, (new, cards) in zip(texts, run(spark, texts), own, strict=True):
        assert new in x.text and x.n_card == cards and x.n_iban == 0, (t, x)


def test_the_key_is_not_in_the_plan(spark, capsys):
    pseudonymised(spark.createDataFrame([(1, "8.8.8.8")], "doc_id long, text string"), "a very secret key").explain(True)
    assert "a very secret key" not in capsys.readouterr().out


def test_a_dense_text(spark):
    """Time a find is about constant: 10,000 numbers and dates in one text, each equal to the plain version's."""
    finds = []
    for i in range(5000):
        body = f"4{i * 7919:014d}"
        finds += [body + next(c for c in "0123456789" if luhn(body + c)), f"{1950 + i % 70}-{i % 12 + 1:02d}-{i % 28 + 1:02d}"]
    began = time.time()
    got = run(spark, [" and ".join(finds)])[0]
    assert time.time() - began < 60
    assert (got.n_card, got.n_date) == (5000, 5000)
    assert got.text == " and ".join(plain("card" if "-" not in x else "date", x) for x in finds)
