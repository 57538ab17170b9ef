"""ledgerline: issue-tracker analytics and corpus preparation as Spark jobs."""
