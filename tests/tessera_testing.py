"""What the tests share besides fixtures, under a name no other folder uses."""

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def write_csv(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path
