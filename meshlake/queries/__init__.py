"""Every operator as a query over the driver's tables, with SQL that checks it."""
