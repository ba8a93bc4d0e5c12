"""Record tables derived from the test tables, and the registered queries over them."""
