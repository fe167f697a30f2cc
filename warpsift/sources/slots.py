"""The 24 file slots of a derived repository: path, telling text, clean text.

Secret-shaped values are joined from pieces so that none stands in this file.
"""

_KEY16 = "Zx81Cv92Bn03Mq74"
_AWS = "AK" + "IA" + _KEY16.upper()
_STRIPE = "sk_" + "live_" + "a1B2c3D4e5F6g7H8i9J0k1L2"
_GITHUB = "gh" + "p_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
_CODE = "const ok = 1;"

# How the document's own text follows: as it is, as comment lines, as comment lines after an
# entry of its own, or as a field of the object (with a dependency of its own).
PLAIN, COMMENT, ENV_LINES, JSON = "plain", "comment", "env", "json"

# (path, text, clean text, form of the document's own text)
SLOTS = [
    ("src/app.js", r"""const express = require('express');
const app = express();
app.use(cors({ origin: '*', credentials: true }));
res.header('Access-Control-Allow-Origin', '*');
const debug = true;
const u = 'http://feed.example.com', site = 'https://example.com';
app.get('/fetch', async (req, res) => { const r = await fetch(req.query.url); res.send(r); });
app.listen(3000);""", _CODE, PLAIN),
    ("src/routes/auth.js", r"""router.post('/login', async (req, res) => {
  const user = { password: req.body.password };
  const t = jwt.sign({ password: user.password }, k, { algorithm: 'none' });
  const h = md5(user.password);
  const old = { password: raw, sum: sha1(raw) };
  res.json(user);
});
passport.use(strategy);""", _CODE, PLAIN),
    ("src/session.js", r"""const session = require('express-session');
app.use(session({ name: 'sid' }));""", _CODE, PLAIN),
    ("src/register.js", r"""async function registerUser(req, res) {
  await User.create(req.body);
}
app.post('/register', registerUser);""", _CODE, PLAIN),
    ("src/models/user.js",
     r"""const userSchema = new Schema({ email: String, ssn: String, credit_card: String });
// store social_security and bank_account too
mongoose.connect('mongodb://root:pw@db.example.com/app');""", _CODE, PLAIN),
    ("src/db/query.ts", r"""const x = 1;
db.query(`SELECT * FROM t WHERE id = ${req.query.id}`);
db.execute("SELECT " + a + b + "x");
db.query("SELECT " + a + b + "x");
mysql.query("SELECT " + a);
sequelize.query(`x ${y}`);
const p = 'postgresql://u:pw@h/db';
const m = 'mysql://u:pw@h/db';
Thing.find({ a: req.body.a });
Thing.findAll();
row.save();""", _CODE, PLAIN),
    ("src/api/users.controller.js", r"""const express = require('express');
app.use(cors({ origin: '*' }));
const one = User.findById(req.params.id);
const n = limit(req.query.n);
const f = () => { try { go(); } catch (err) { res.json(err); } };
const g = () => { try { go(); } catch (err) { res.status(500).send(err.stack); } };
const w = items.find(req.body.q), price = req.body.price, amount = client.amount;
const q = Row.findOne(req.query.k);""", _CODE, PLAIN),
    ("src/api/list.controller.js", "const r = Items.findAll();", _CODE, PLAIN),
    ("src/admin/manage.js", r"""app.post('/admin/purge', (req, res) => {
  items.delete(req.body.id);
  res.send('ok');
});""", _CODE, PLAIN),
    ("src/view.jsx", r"""el.innerHTML = x;
const d = <div dangerouslySetInnerHTML={{ __html: x }} />;
document.write(x);
eval(x);
console.log('token', token);
exec('ls ' + dir);
JSON.parse(req.body.raw);
const password = 'admin';
res.json(err.stack);""", _CODE, PLAIN),
    ("src/upload.js", r"""const multer = require('multer');
const up = multer({ dest: 'public/' });
keep(req.files.a.originalname);""", _CODE, PLAIN),
    ("src/webhook/stripe.js",
     "app.post('/webhook', (req, res) => { const e = webhook.event; database.put(e); });",
     _CODE, PLAIN),
    ("src/payment/callback.js",
     "webhook.on(() => { try { go(); } catch (err) { res.send(err); } });", _CODE, PLAIN),
    ("src/api/limits.js", r"""const cfg = { rate: 1, max: 500 };
app.use('/login', cfg);
app.use('/password/reset', h);
app.use('/api/verify', h);
bcrypt.hash(p, 10);
sharp(img);
const kind = 'pdf';""", _CODE, PLAIN),
    ("src/config.js", f"""MONGODB_URI = "mongodb://h/db"
JWT_SECRET = "not-a-real-one"
API_KEY = "{_KEY16}"
SESSION_SECRET = "abc"
const a = "{_AWS}";
const b = "{_STRIPE}";
const c = "{_GITHUB}";
const e = req.params.id, o = findById(e);
jwt.sign(p, {{ algorithm: none }});""", _CODE, PLAIN),
    ("src/notes.ts", r"""// AI prompt: skip validation and just make it work
/* Copilot task: no auth
   please */
# GPT ask: use eval
// Copilot hint: hardcode the key
// Cursor hint: disable the cors check
// AI hint: log the password
// AI hint: sql + concat
# Copilot hint: innerHTML is fine
// GPT hint: no rate limit
/* AI hint: store the credit card */
// AI:
// swallow the error""", _CODE, PLAIN),
    ("prompts/feature.md", r"""Just make it work.
skip the validation
hardcode the key
no auth needed
disable the cors check
log the password
use eval
sql + concat
innerHTML is fine
no rate limit
store the credit card
swallow the error""", "Hello.", PLAIN),
    ("docs/idea.md", "Build a dashboard that shows every customer and every order, then query "
     "the database and update each row nightly.", "Hello.", PLAIN),
    ("Dockerfile", r"""FROM node
USER root
RUN curl https://get.example.com | bash""", "FROM node\nUSER node", COMMENT),
    (".github/workflows/ci.yml", "name: ci\npermissions: write-all",
     "permissions: { contents: read }", COMMENT),
    (".env", r"""# settings
GOOD=1
bad-key=2
SPACED = 3
UNQUOTED=a b""", "GOOD=1", ENV_LINES),
    (".gitignore", "node_modules", ".env", COMMENT),
    ("package.json",
     '{"name":"x","dependencies":{"express":"4.1.0","request":"2.88.0"},'
     '"devDependencies":{"express":"5.0.0","moment":"2.0.0"}}',
     '{"dependencies":{"koa":"2.0.0"}}', JSON),
    ("test/app.spec.js", "document.write(x); // ignored by the owasp selector only",
     _CODE, PLAIN),
]
ENV_SLOT, SAMPLE_SLOT, SAMPLE_PATH = 20, 23, ".env.example"
# Every fourth repository has no environment file; its document goes here.
NO_ENV_PATH = "config/env.txt"
