"""Column functions: parsing, labels and the distributions behind the tests."""
