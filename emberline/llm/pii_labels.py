"""A small labelled table for the personal-data tagger: marked spans in invented sentences."""

# Each row is a text; {kind|span} marks personal data. All names and numbers are invented.
LABELLED = """
call me at {phone|+1 (212) 555-0143} before noon
my phone is {phone|+44 20 7946 0018} and I am at home
reach the office under {phone|(617) 555-0172} or by letter
tel: {phone|617-555-0181}
phone {phone|(303) 555-0119}, ask for the manager
tel {phone|415.555.0136} at any time
mobile: {phone|555-0127-884}
fax {phone|(202) 555-0164}
{phone|(404) 555-0188} is the number to call
please ring {phone|312-555-0155} for details
our hotline: {phone|+49 30 5550 1234}
or text {phone|(808) 555-0107}
call {phone|808 555 0123} today
whatsapp {phone|+33 1 55 50 12 34}
write to {email|jane.doe@mail.example.com} today
mail {email|info@example.org}, we answer soon
her address {email|a_b-c%d@sub.example.net}. Thanks
contact: {email|support+eu@example.com}
the host {ip|192.0.2.17} did not answer
ping {ip|198.51.100.4} and {ip|203.0.113.250} again
login from {ip|10.20.30.40}, denied
paid with card {card|4111 1111 1111 1111} on Monday
card no. {card|5500-0000-0000-0004} expires soon
visa {card|4012888888881881} was declined
amex {card|3782 822463 10005} accepted
mastercard {card|5105105105105100}
lorem {email|dolor.12@box3.example.com} ipsum
sit | {email|amet9@box.example.org}. | elit
magna, {email|ut.77@post5.example.net} enim
ipsum {ip|203.0.113.9} dolor sit
amet | {ip|198.51.100.77} | elit
tempor, {ip|192.0.2.201}.
lorem ipsum {card|4222222222222220} dolor
sit | {card|6011000990139424} | amet
enim {card|3530111333300000}, minim
quis {card|5555555555554444} nostrud
minim {phone|+1 (555) 555-0101} veniam
quis | {phone|+1 (019) 555-0177} | nostrud
dolor {phone|(555) 555-0102} sit
{email|x.y@example.com} and {phone|+1 (415) 555-0199} are on file
he moved there in 1998 and left in 2004
the meeting on 2024-03-17 was moved to 2024-04-02
from 12.05.2019 until 30.06.2020
between 1990-1995 sales rose by 12.5 %
it costs 1,299.00 or 1.299,00 with tax
order 100234 shipped in 3 boxes of 24
version 3.14.2 replaces 3.13.11
section 4.2.1.7 of part 12
room 404, floor 3, building 12
see pages 112-118 and 203
isbn 978-3-16-148410-0 is out of print
a score of 10-7 after 90 minutes
the code 7f5790b897549d620aedfc0705a565f96e is secret
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
id 8f14e45f-ceea-467f-a0e6-36dabe3c1f2b
commit 9e9329b fixed bug 1834
the year 2023 had 365 days and 12 months
at 10:45:30 the train had 25 cars
lot 20230405123456 of 1200 pieces
serial 1234 5678 was replaced
about 3 000 000 people in 1900
row 1 2 3 4 5 6 7 8 9 10
matrix 10 20 30 40 50 60
10 | 20 | 30 | 40
ratio 16:9 or 4:3
coordinates 48.8584, 2.2945
population 67 390 000
sum 1234567.89 eur
price $19.99 each, 3 for $50
temperature -12.5 and +30 degrees
+5 points, then +12 more
pay @ 12 each
twitter @someone99 said so
mail4 and v2 are names
ip v4 or ip v6
3rd of 5, 21st of 30
7-zip 19.00 and mp3
abc123 def456
invoice 2021-000123 of 2021-11-30
tracking 1Z9999999999
zip 90210 or 10115
call 3 people in 2 days
phone 12 has 3 cameras
tel {phone|030 5550123}
tel {phone|0171 5550188} or by mail
telefon: {phone|0221 555 0146}
tel. {phone|040/5550177}
ring {phone|555-0119} after six
ref {phone|555-0164}
call {phone|555-0133} now
dial {phone|1-800-555-0142}
number {phone|1-888-555-0120}, toll free
fax: {phone|0511/555-0190}
contact {phone|020 7946 0155}
mobile {phone|07700 900123} any day
cell {phone|(305)555-0171}
phone number {phone|555 0182}
phone number is {phone|716 555 0110}
my number is {phone|555-0158}, call me
call us on {phone|01632 960101}
llame al {phone|91 555 01 23}
appelez le {phone|01 55 50 12 99}
tel {phone|06 55 50 13 44} le soir
anruf unter {phone|089 5550 234}
hotline {phone|0800 555 0111}
text me at {phone|917-555-0102}
sms to {phone|0049 30 5550166}
{phone|(702) 555-0135}, {phone|(702) 555-0136}
write {email|jürgen@müller.example} please
mail an {email|rené.dupont@société.example}
an {email|søren@ørsted.example.dk}, danke
{email|josé@correo.example} escribe
e-mail {email|o'hara@example.org} soon
{email|anna&bob@home.example} lorem
send to {email|root@localhost}
mail {email|admin@intranet}, thanks
ask {email|info@münchen.example} ipsum
({email|zoë@café.example})
host {ip|2001:db8::17} is down
ping {ip|fe80::1ff:fe23:4567:890a} again
from {ip|2001:db8:85a3::8a2e:370:7334} denied
address {ip|2001:db8:0:1::5}, port 80
login {ip|fd12:3456:789a::1} ok
lorem {ip|2001:db8::a:9} ipsum
card {card|4111.1111.1111.1111} was used
visa {card|4012.8888.8888.1881}
card {card|5555/5555/5555/4444} expired
mastercard {card|5105.1051.0510.5100} ok
paid with {card|4222222222222} on Monday
lorem {card|4000.0566.5566.5556} ipsum
on page 030 1234567 words
the sum of 555-0100 is negative
chapter 12-15 and 20-25
version 10.2.3-4 and 1.2.3.4.5
section 555-12 of the code
order no. 555-0100-77 shipped
order 4111.1111.1111.1112 shipped
part 030-1234567 is in stock
item 5550123 of 7000000
in 030 cases of 1234567
from 1914-1918 and 1939-1945
times 10:45 and 11:30:15
at 12:00:00 and 00:15
mac 00:1b:44:11:3a:b7
hash a1b2:c3d4
scores 3:2 and 1:0
aspect 4:3, 16:10, 21:9
verse 3:16 of 1:1
ratio 1:1000
3 @ 5 each
@anna1 and @bob2
price @ 3.50
in 1999/2000 and 2001/02
on 12/05/2019 or 05/12/19
1/2 cup, 3/4 spoon
24/7 service
grew 12 345 to 67 890
12 345 678 people
sum 1.234.567 eur
1.234.567,89 in total
figures 100 200 300
years 1990 1995 2000
id 555 of 0123
building 555 room 0123
lot 555-0100 of the auction
file 030-555.txt
lorem 4970 ipsum 12 dolor
lorem 123-456 ipsum
lorem 2021 555 dolor
dolor 12-34-56 sit
sit 20 30 40 amet
""".strip().split("\n")

# Rows of the same kind that the tagger never learns from.
HELD_OUT = """
please call {phone|555-0147} tonight
tel {phone|030 1234567}
ref {phone|555-0100}
phone {phone|0231 5550144}, ask for her
ring me: {phone|(212)555-0188}
mobile {phone|07700 900456} is best
contact {phone|1-800-555-0175} today
fax {phone|(415) 555-0126}
fax: {phone|0621/5550133}
call us on {phone|01632 960744} daily
text me at {phone|646-555-0107}
my number is {phone|555-0161}
tel {phone|06 55 50 17 28} demain
hotline {phone|0800 555 0199}
dial {phone|312.555.0164} first
whatsapp {phone|+44 7700 900321}
write to {email|müller@exämple.de} please
mail {email|françois@école.example}
an {email|björn@håndværk.example.no}, danke
{email|peña@niño.example} escribe
send to {email|backup@localhost}
e-mail {email|d'arcy@example.net} soon
her address {email|mary.k@mail.example.co} lorem
host {ip|2001:db8::42} is up
ping {ip|fe80::2aa:ff:fe9a:4ca2} again
from {ip|2001:db8:1234::7:1} denied
login from {ip|203.0.113.77}, ok
lorem {ip|2001:db8::b:3} ipsum
visa {card|4556.7375.8689.9855}
card {card|4485.2757.4230.8327} was used
paid with {card|4716 1080 9990 4417} again
mastercard {card|5425.2334.3010.9903} ok
on page 040 7654321 words
in 2003 and 2007 about 14 of 520
order no. 555-0199-31 shipped
from 1870-1871 and 1914-1918
times 09:15 and 17:45:30
mac 00:0c:29:4f:8e:35
verse 4:12 of 2:3
5 @ 7 each
twitter @some77 said so
on 07/11/2018 or 11/07/18
grew 98 765 to 123 456
45 678 901 people
order 4556.7375.8689.9856 shipped
room 512, floor 5, building 9
isbn 978-0-306-40615-7 is rare
serial 8765 4321 was replaced
version 4.15.3 replaces 4.14.12
figures 150 250 350
the code 3b5790b897549d620aedfc0705a565f9aa is secret
id 2f14e45f-ceea-467f-a0e6-36dabe3c1f9c
row 9 8 7 6 5 4 3 2 1
sum 7654321.98 eur
commit 4e9329b fixed bug 2291
lorem 654-321 ipsum
building 512 room 0199
between 2010-2015 sales fell by 7.5 %
""".strip().split("\n")
