"""Column functions: expressions over built-ins, no Python in the data path."""
