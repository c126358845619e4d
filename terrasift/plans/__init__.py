"""Named queries over the logical tables, each with its SQL oracle where SQL can say it."""
