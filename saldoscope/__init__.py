"""saldoscope: transaction-risk analytics over a whole book of accounts, on Spark."""
