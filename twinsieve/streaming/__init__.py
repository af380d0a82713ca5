"""Nothing here: the domain has no streams; "progressive" is an order of results of a batch run."""
