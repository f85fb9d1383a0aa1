"""Where the tests read the given tables."""

FOLDER = "/root/testdata/sf0.001"
