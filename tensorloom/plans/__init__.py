"""Named queries over the data folders, each with the SQL that must give the same rows where SQL can."""
