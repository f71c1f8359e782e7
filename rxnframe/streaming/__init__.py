"""No streaming operators: row-wise ones (keys, classes, filters, group splits, feature arrays) take a streaming DataFrame as it is."""
